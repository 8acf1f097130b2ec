"""Large moves and what surrounds them: market model, windows of counts, forward sums, control groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.operators import frames


def market_model(rows: DataFrame, n: int = 250, least: int = 120, sigma_n: int = 60, sigma_least: int = 40) -> DataFrame:
    """rows (code, pos, ret, mkt_ret) with beta over the n rows before, ar = ret - beta * mkt_ret, and sigma, ar's deviation over the sigma_n rows before; the row itself never counts.

    The sums behind beta are differences of running totals, so that a row costs the same whatever n.
    """
    w = frames.ordered(["code"], "pos")
    both = F.col("ret").isNotNull() & F.col("mkt_ret").isNotNull()
    x, y = (F.when(both, F.col(c)).otherwise(0.0) for c in ("mkt_ret", "ret"))
    sums = {"n": both.cast("double"), "x": x, "y": y, "xx": x * x, "xy": x * y}
    m = rows.withColumns({f"__{k}": frames.running(F.sum, v, w) for k, v in sums.items()})
    m = m.withColumns({f"__{k}": frames.between(f"__{k}", w, n) for k in sums})
    spread = F.col("__n") * F.col("__xx") - F.col("__x") * F.col("__x")
    beta = F.when((F.col("__n") >= least) & (spread > 0), (F.col("__n") * F.col("__xy") - F.col("__x") * F.col("__y")) / spread)
    m = m.withColumn("beta", beta).drop(*[f"__{k}" for k in sums]).withColumn("ar", F.col("ret") - F.col("beta") * F.col("mkt_ret"))
    return m.withColumn("sigma", frames.rolling(F.stddev_samp, F.col("ar"), w, sigma_n, sigma_least, until=-1))


def flag_events(m: DataFrame, z: float = 3.0, size: float = 0.03, cluster: float = 0.05, barred: Column | None = None) -> DataFrame:
    """m with z, eligible (ar and z known, and not barred), event, up, and cluster: whether the share of eligible codes with an event of the same sign that day reaches cluster."""
    e = m.withColumn("z", F.col("ar") / F.nullif(F.col("sigma"), F.lit(0.0)))
    ok = F.col("ar").isNotNull() & F.col("z").isNotNull()
    if barred is not None:
        ok = ok & ~F.coalesce(barred, F.lit(False))
    e = e.withColumn("eligible", ok).withColumn("event", F.coalesce(ok & (F.abs("z") >= z) & (F.abs("ar") >= size), F.lit(False))).withColumn("up", F.coalesce(F.col("ar") > 0, F.lit(False)))
    day = e.filter("eligible").groupBy("date").agg(F.count("*").alias("__n"), F.count_if(F.col("event") & F.col("up")).alias("__u"), F.count_if(F.col("event") & ~F.col("up")).alias("__d"))
    share = F.when(F.col("up"), F.col("__u")).otherwise(F.col("__d")) / F.col("__n")
    return e.join(day, "date", "left").withColumn("cluster", F.coalesce(F.col("event") & (share >= cluster), F.lit(False))).drop("__n", "__u", "__d")


def day_flags(rows: DataFrame, halt_gap: int = 5) -> DataFrame:
    """rows (code, pos, close, base) with adj: the base isn't the close before, and halt: more than halt_gap positions since the code's row before."""
    w = frames.ordered(["code"], "pos")
    moved = F.abs(F.col("base") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1) > 1e-6
    return rows.withColumns({"adj": F.coalesce(moved, F.lit(False)), "halt": F.coalesce(F.col("pos") - F.lag("pos").over(w) > halt_gap, F.lit(False))})


#: Days in each window around an event: the five before, the day itself up to the open and after it, the next, and the four after that.
WINDOWS = {"pre5": 5, "preopen": 1, "intraday": 1, "next": 1, "post": 4}


def window_counts(rows: DataFrame, pre: str, intra: str, by: Sequence[str] = ("code",), base: tuple[int, int] = (-25, -6)) -> DataFrame:
    """rows (by, pos, pre, intra), dense in pos, with the count of each of WINDOWS and base, the mean of log1p of a day's count over base; null where a window reaches beyond the rows or over an unknown count."""
    w = frames.ordered(by, "pos")
    d = rows.withColumn("__full", F.col(pre) + F.col(intra))
    sums = {name: frames.gated(F.sum("__full"), F.col("__full"), w.rangeBetween(a, b), b - a + 1) for name, (a, b) in {"pre5": (-5, -1), "next": (1, 1), "post": (2, 5)}.items()}
    mean = frames.gated(F.avg(F.log1p("__full")), F.col("__full"), w.rangeBetween(*base), base[1] - base[0] + 1)
    return d.withColumns({**sums, "preopen": F.col(pre), "intraday": F.col(intra), "base": mean}).drop("__full")


def known_windows(windows: DataFrame, cal: DataFrame, start: str, end: str, base: int = 25, after: int = 5) -> DataFrame:
    """windows with all counts null where the data, from start to end (without it), don't hold everything from the close before the base's first day to the last day after."""
    w = Window.orderBy("pos")
    ends = cal.select("pos", (F.coalesce(F.lag("date", base + 1).over(w) >= F.lit(start).cast("date"), F.lit(False)) & F.coalesce(F.lead("date", after).over(w) < F.lit(end).cast("date"), F.lit(False))).alias("__ok"))
    j = windows.join(F.broadcast(ends), "pos", "left")
    return j.select(*[F.when(F.col("__ok"), F.col(c)).alias(c) if c in (*WINDOWS, "base") else F.col(c) for c in windows.columns])


def outcome(x: Column, length: int, base: Column) -> tuple[Column, Column, Column]:
    """(any, log, abnormal) of a window's count: 0/1, log1p, and log1p of the daily mean less base; null stays null."""
    return F.when(x.isNotNull(), (x > 0).cast("double")), F.log1p(x), F.log1p(x / length) - base


def stock_lags(m: DataFrame, locked: str) -> DataFrame:
    """m (code, pos, ar, sigma, volume, locked) with what is known of the row before: abs_z1, log_sigma, lock1 and lvol_abn1, log volume less its mean over the 20 rows before that."""
    w = frames.ordered(["code"], "pos")
    lv = F.when(F.col("volume") > 0, F.log("volume"))
    return m.withColumns(
        {
            "abs_z1": F.abs(F.lag("ar").over(w)) / F.nullif(F.col("sigma"), F.lit(0.0)),
            "log_sigma": F.when(F.col("sigma") > 0, F.log("sigma")),
            "lock1": F.lag(F.col(locked).cast("double")).over(w),
            "lvol_abn1": F.lag(lv).over(w) - frames.gated(F.avg(lv), lv, w.rowsBetween(-21, -2), 20),
        }
    )


def volume_design(px: DataFrame, by: Sequence[str] = ("code",), order: str = "pos") -> DataFrame:
    """px, dense in order, with the targets and lags of a volume and range model: y_lv, y_vol and of each the row before and the means of the 5 and 22 before (null unless all are there), abs_r1, neg_r1, lock_up1, lock_dn1, and gap_abs and gap_neg of the day itself."""
    w = frames.ordered(by, order)
    spread = F.when((F.col("high") > F.col("low")) & (F.col("low") > 0), F.log(F.log(F.col("high") / F.col("low"))))
    d = px.withColumns({"y_lv": F.when(F.col("volume") > 0, F.log("volume")), "y_vol": spread})
    lags = {f"{y}_l{n}": frames.rolling(F.avg, F.col(y), w, n, until=-1) for y in ("y_lv", "y_vol") for n in (1, 5, 22)}
    r1 = F.lag("ret").over(w)
    neg = lambda x: F.when(x.isNotNull(), F.least(x, F.lit(0.0)))
    return d.withColumns({**lags, "abs_r1": F.abs(r1), "neg_r1": neg(r1), "lock_up1": F.lag(F.col("limit_up_close").cast("double")).over(w), "lock_dn1": F.lag(F.col("limit_down_close").cast("double")).over(w), "gap_abs": F.abs("gap"), "gap_neg": neg(F.col("gap"))})


def abnormal_returns(ev: DataFrame, dense: DataFrame, horizons: Sequence[int] = (1, 5, 20, 60), pre: Sequence[int] = (20, 5), least: int = 50) -> DataFrame:
    """ev (code, pos, ...) with what codes did around: sums of returns, null where a day is missing.

    dense: (code, pos, ret, mkt_ret, value). car_h and raw_h are the returns of the h days after the
    entry less the market's, and as they are; pre_k those of the k days before, day0 that of the
    day; mm_h the ones less what a market model of days -250 to -30 expects (120 at least); bm_h
    those less the mean of the codes alike that day in liquidity and past return, of five groups
    each. Every code's day is a row of dense, so that all are frames over it and one equality join.
    """
    w = frames.ordered(["code"], "pos")
    d = dense.withColumn("__ar", F.col("ret") - F.col("mkt_ret"))
    past = w.rowsBetween(-250, -30)
    both = F.col("ret").isNotNull() & F.col("mkt_ret").isNotNull()
    y, x = F.when(both, F.col("ret")), F.when(both, F.col("mkt_ret"))
    enough = (F.count(y).over(past) >= 120) & (F.col("pos") >= 250)
    slope = F.when(enough, F.covar_pop(y, x).over(past) / F.nullif(F.var_pop(x).over(past), F.lit(0.0)))
    d = d.withColumns({"__b": slope, "__my": F.avg(y).over(past), "__mx": F.avg(x).over(past)})
    spans = {f"car_{h}": ("__ar", 1, h) for h in horizons} | {f"raw_{h}": ("ret", 1, h) for h in horizons} | {f"pre_{k}": ("__ar", -k, -1) for k in pre} | {"day0": ("__ar", 0, 0)} | {f"__m_{h}": ("mkt_ret", 1, h) for h in horizons}
    d = d.withColumns({name: frames.gated(F.sum(c), F.col(c), w.rowsBetween(a, b), b - a + 1) for name, (c, a, b) in spans.items()})
    d = d.withColumns({f"mm_{h}": F.col(f"raw_{h}") - ((F.col("__my") - F.col("__b") * F.col("__mx")) * h + F.col("__b") * F.col(f"__m_{h}")) for h in horizons})
    d = d.withColumns({"__liq": frames.rolling(F.avg, F.col("value"), w, 20, 10), "__past": frames.rolling(F.sum, F.col("ret"), w, 20, 15)})
    out = ev.join(d.select("code", "pos", *[c for c in d.columns if c.startswith(("car_", "raw_", "pre_", "mm_")) or c == "day0"]), ["code", "pos"], "left")
    days = ev.select("pos").distinct()
    for h in horizons:
        on = d.filter(F.col(f"raw_{h}").isNotNull()).join(days, "pos", "left_semi").select("code", "pos", "__liq", "__past", F.col(f"raw_{h}").alias("__r"))
        cells = benchmark_cells(on, "pos", "__liq", "__past", least=least).filter("cell is not null").select("code", "pos", "cell", "__r")
        mean = cells.groupBy("pos", "cell").agg(F.avg("__r").alias("__m"))
        out = out.join(cells.join(mean, ["pos", "cell"]).select("code", "pos", (F.col("__r") - F.col("__m")).alias(f"bm_{h}")), ["code", "pos"], "left")
    return out


def signed_forward(ar: Column, k: int, by: Sequence[str] = ("code",)) -> Column:
    """sign(ar) times the sum of the next k rows' ar; null where one is missing."""
    return F.signum(ar) * frames.forward_sum(ar, frames.ordered(by, "pos"), k)


def window_sums(dense: DataFrame, x: str, spans: dict[str, tuple[int, int]], by: Sequence[str] = ("code",)) -> DataFrame:
    """dense with the sum of x over rows a .. b around each, null unless all are there."""
    w = frames.ordered(by, "pos")
    return dense.withColumns({name: frames.gated(F.sum(x), F.col(x), w.rowsBetween(a, b), b - a + 1) for name, (a, b) in spans.items()})


def benchmark_cells(rows: DataFrame, day: str, first: str, second: str, keys: Sequence[str] = ("code",), n: int = 5, least: int = 50) -> DataFrame:
    """rows with cell: n groups of first times n groups of second per day, over rows that have both, ties in the order of keys; null on days with fewer than least."""
    ok = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    size = F.count("*").over(Window.partitionBy(day))
    group = lambda c: frames.quantile_group([day], [F.col(c), *[F.col(k) for k in keys]], n)
    cells = ok.withColumn("__n", size).withColumn("__a", group(first)).withColumn("__b", group(second))
    return cells.withColumn("cell", F.when(F.col("__n") >= least, F.col("__a") * n + F.col("__b"))).drop("__n", "__a", "__b")


def calendar_time(events: DataFrame, dense: DataFrame, h: int) -> DataFrame:
    """(pos, long, short, spread): mean ar over the events open that day, entered up to h rows before, by direction; only days with both legs."""
    from boardlens.operators.joins import band

    open_ = band(events.select("code", F.col("pos").alias("__e"), "up"), dense.select("code", "pos", "ar"), ["code"], "__e", "pos", 1, h)
    legs = open_.groupBy("pos").agg(F.avg(F.when(F.col("up"), F.col("ar"))).alias("long"), F.avg(F.when(~F.col("up"), F.col("ar"))).alias("short"))
    return legs.filter("long is not null and short is not null").withColumn("spread", F.col("long") - F.col("short"))


def drop_close_repeats(events: DataFrame, by: Sequence[str], pos: str, order: Sequence[str], gap: int) -> DataFrame:
    """events without those within gap positions of the one before of the same by, kept or not."""
    w = frames.ordered(by, [F.col(o) for o in order])
    back = F.col(pos) - F.lag(pos).over(w)
    return events.withColumn("__back", back).filter("__back is null or __back > " + str(gap)).drop("__back")


def past_hit_rate(events: DataFrame, by: Sequence[str], pos: str, hit: str, closed_after: int, least: int) -> Column:
    """Share of hits among a by's events that had closed before: those more than closed_after positions back; null with fewer than least."""
    w = frames.ordered(by, pos).rangeBetween(-(2**31), -(closed_after + 1))
    return F.when(F.count(hit).over(w) >= least, F.avg(F.col(hit).cast("double")).over(w))


def first_touch(events: DataFrame, bars: DataFrame, by: Sequence[str], horizon: int) -> DataFrame:
    """events (by, event_id, pos, target, stop) with outcome: target, stop, both (the same day) or none, whichever a bar (pos, high, low) of the next horizon rows touches first."""
    from boardlens.operators.joins import band

    near = band(events, bars.select(*by, F.col("pos").alias("__p"), "high", "low"), by, "pos", "__p", 1, horizon)
    hit = near.groupBy("event_id").agg(F.min(F.when(F.col("high") >= F.col("target"), F.col("__p"))).alias("__t"), F.min(F.when(F.col("low") <= F.col("stop"), F.col("__p"))).alias("__s"))
    t, s = F.col("__t"), F.col("__s")
    what = F.when(t.isNull() & s.isNull(), "none").when(t == s, "both").when(s.isNull() | (t < s), "target").otherwise("stop")
    return events.join(hit, "event_id", "left").withColumn("outcome", what).drop("__t", "__s")
