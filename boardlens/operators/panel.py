"""Long panels of traded stock-days: returns, flags, market series and trailing features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.operators import frames
from boardlens.operators.calendar import week_key


def traded(rows: DataFrame) -> DataFrame:
    """One row per (code, market, date) with a close and a volume, its figures only; repeated rows count once, before any lag sees them. Names are left out: a text among the figures would turn the hash aggregation into a sort."""
    ok = rows.filter("close > 0 and volume > 0")
    cols = [c for c in ("open", "high", "low", "close", "volume", "value") if c in rows.columns]
    return ok.groupBy("code", "market", "date").agg(*[F.max(c).alias(c) for c in cols])


#: A listed company's code, not a fund's, which begins with 0.
COMMON = r"^[1-9][0-9]{3}$"


def common(code: Column, name: Column) -> Column:
    """Whether a code and name are a common stock's: no fund, no depositary receipt."""
    return F.coalesce(code.rlike(COMMON) & ~name.endswith("-DR"), F.lit(False))


def returns(panel: DataFrame, reference: DataFrame | None = None, limit: float = 0.105) -> DataFrame:
    """panel with base, ret, oc, gap and limit flags at the open and the close.

    base is the close of the row before of the same code and market; on TWSE the reference price
    (code, date, ref) of days that have one, on TPEx the row before's ref_next, where panel has it.
    ret and gap are null beyond the limit. A day is limit-up from 1.095 times base on TWSE, from
    0.999 times the row before's limit_up_next on TPEx; limit-down from 0.905 times base; flags of
    missing figures are false.
    """
    w = frames.ordered(["code", "market"], "date")
    before = lambda c: F.lag(c).over(w) if c in panel.columns else F.lit(None).cast("double")
    p = panel.withColumns({"__prev": before("close"), "__next": before("ref_next"), "__up": before("limit_up_next")})
    twse = F.col("market") == "TWSE"
    if reference is not None:
        p = p.join(reference.select("code", "date", "ref"), ["code", "date"], "left")
    p = p.withColumn("base", F.when(twse, F.coalesce("ref", "__prev") if reference is not None else F.col("__prev")).otherwise(F.coalesce("__next", "__prev")))
    ok = F.col("base") > 0
    ret = F.when(ok, F.log(F.col("close") / F.col("base")))
    p = p.withColumn("__ret", ret).withColumn("__beyond", F.coalesce(F.abs(F.expm1("__ret")) > limit, F.lit(False)))
    up = F.when(twse, F.col("base") * 1.095).otherwise(F.col("__up") * 0.999)
    flags = {f"limit_{side}_{at}": F.coalesce(F.col(at) >= up if side == "up" else F.col(at) <= F.col("base") * 0.905, F.lit(False)) for at in ("open", "close") for side in ("up", "down")}
    return p.withColumns(
        {
            "ret": F.when(~F.col("__beyond"), F.col("__ret")),
            "oc": F.when(F.col("open") > 0, F.log(F.col("close") / F.col("open"))),
            "gap": F.when(ok & ~F.col("__beyond") & (F.col("open") > 0), F.log(F.col("open") / F.col("base"))),
            **flags,
        }
    ).drop("__ret", "__beyond", "__prev", "__next", "__up", "ref")


def market_returns(p: DataFrame, weight: str = "value", times: str | None = None) -> DataFrame:
    """(date, market, mkt_ret, n): mean simple return weighted by the row before's weight, as a log return.

    With weight shares and times base the weights are yesterday's capitalisation.
    """
    w = frames.ordered(["code", "market"], "date")
    own = F.lag(weight).over(w) * (F.col(times) if times else F.lit(1.0))
    q = p.withColumn("__w", own).filter("ret is not null and __w > 0")
    simple = F.sum(F.col("__w") * F.expm1("ret")) / F.sum("__w")
    return q.groupBy("date", "market").agg(F.log1p(simple).alias("mkt_ret"), F.count("*").alias("n"))


def with_market(p: DataFrame, market: DataFrame) -> DataFrame:
    """p with its market's return; the market side is one row per day and market."""
    return p.join(F.broadcast(market.select("date", "market", "mkt_ret")), ["date", "market"], "left")


def listed_names(panel: DataFrame) -> DataFrame:
    return panel.filter("code is not null and name is not null").groupBy("code", "name").agg(F.min("date").alias("first"), F.max("date").alias("last"))


def price_features(p: DataFrame) -> DataFrame:
    """Per code and market: ret and its lags 1 to 4, sums over 5, sample deviation over 20, log volume against the 20 rows before, and p's oc, mkt_ret and close; null where a frame isn't full."""
    w = frames.ordered(["code", "market"], "date")
    r, v = F.col("ret"), F.when(F.col("volume") > 0, F.log("volume"))
    return p.select(
        "code", "market", "date", "ret",
        *[F.lag("ret", k).over(w).alias(f"ret_lag{k}") for k in (1, 2, 3, 4)],
        frames.rolling(F.sum, r, w, 5).alias("ret_5"),
        frames.rolling(F.stddev_samp, r, w, 20).alias("vol_20"),
        ((v - frames.rolling(F.avg, v, w, 20, until=-1)) / F.nullif(frames.rolling(F.stddev_samp, v, w, 20, until=-1), F.lit(0.0))).alias("vlm_z"),
        *[c for c in ("oc", "mkt_ret", "close") if c in p.columns],
    )


def targets(p: DataFrame, of: str = "ret") -> DataFrame:
    """p with the next row's return (or its oc, with of="oc"), whether that is above 0 (a flat one isn't), and date; with mkt_ret also excess_next."""
    w = frames.ordered(["code", "market"], "date")
    nxt = F.lead(of).over(w)
    more = {"excess_next": F.lead(F.col("ret") - F.col("mkt_ret")).over(w)} if "mkt_ret" in p.columns else {}
    return p.withColumns({"ret_next": nxt, "up_next": F.when(nxt.isNotNull(), (nxt > 0).cast("int")), "target_date": F.lead("date").over(w), **more})


def weekly(daily: DataFrame, last: Sequence[str], mean: Sequence[str], start: str | None = None, end: str | None = None, by: Sequence[str] = ("code", "market")) -> DataFrame:
    """A row per Saturday-to-Friday week: date, its last day with a row, that day's `last` columns, the week's means of `mean`, ret_next, the sum of the next week's ret (null if a day's is missing), and target_end, its last day.

    Only weeks that end from start on and whose next ends before end, where given; without a next week there is no target.
    """
    w = frames.ordered(by, "__week")
    g = daily.groupBy(*by, week_key(F.col("date")).alias("__week")).agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in last], *[F.avg(c).alias(c) for c in mean], frames.strict_sum(F.col("ret")).alias("__ret"))
    g = g.withColumns({"ret_next": F.lead("__ret").over(w), "target_end": F.lead("date").over(w)})
    ok = F.lit(True)
    if start:
        ok = ok & (F.col("date") >= F.lit(start).cast("date"))
    if end:
        ok = ok & (F.col("target_end") < F.lit(end).cast("date"))
    return g.filter(ok).drop("__week", "__ret")


def hedged(ret: Column, market: Column) -> Column:
    """The log return of one share held against as much of the market sold."""
    return F.log1p(F.expm1(ret) - F.expm1(market))


def signed(x: Column) -> Column:
    """1 up, 0 down, null when flat or unknown: the direction of a move, where targets' up_next asks for a rise."""
    return F.when(x > 0, 1).when(x < 0, 0)


def period(rows: DataFrame, start: str, end: str, final_from: str, final: bool = False, date: str = "date", target: str = "target_date") -> DataFrame:
    """rows from start whose target lies up to end; unless final, none whose target lies in the final test from final_from on. A row without a target day is in no period."""
    last = F.col(target) <= F.lit(end).cast("date")
    if not final:
        last = last & (F.col(target) < F.lit(final_from).cast("date"))
    return rows.filter((F.col(date) >= F.lit(start).cast("date")) & last)


def dense_returns(p: DataFrame, cal: DataFrame) -> DataFrame:
    """(code, date, pos, ret, market): every trading day from a code's first row to its last; a day without trade has return 0 and the market of the row before."""
    one = p.groupBy("code", "date").agg(F.max("ret").alias("ret"), F.min("market").alias("market"), F.lit(True).alias("traded"))
    grid = frames.dense_grid(one, cal, "code").join(one, ["code", "date"], "left")
    w = frames.ordered(["code"], "pos")
    return grid.select("code", "date", "pos", F.when(F.col("traded"), F.col("ret")).otherwise(0.0).alias("ret"), frames.filled_both_ways(F.col("market"), w).alias("market"), F.coalesce("traded", F.lit(False)).alias("traded"))


def trailing_signals(dense: DataFrame, value: str = "value") -> DataFrame:
    """12-1 momentum, volatility, liquidity and the number of returns in a year, over rows of a dense grid."""
    w = frames.ordered(["code"], "pos")
    r = F.coalesce("ret", F.lit(0.0))
    return dense.select("code", "date", "pos", (F.sum(r).over(w.rowsBetween(-251, 0)) - F.sum(r).over(w.rowsBetween(-20, 0))).alias("mom"), frames.rolling(F.stddev_samp, F.col("ret"), w, 252, 200).alias("vol"), frames.rolling(F.avg, F.col(value), w, 60, 40).alias("liq"), F.count("ret").over(w.rowsBetween(-251, 0)).alias("n_obs"))


def factor_choice(signals: DataFrame, day: str = "date", least_obs: int = 200, liquid: int = 300, n: int = 50, fewer: int = 30) -> DataFrame:
    """(day, factor, code, rank): of the `liquid` most liquid codes of each day the first n by momentum, low volatility, liquidity and the sum of the ranks of the first two, and the `fewer` first by momentum.

    signals: trailing_signals of the days of choice, the codes that may be bought only. Ties go by code.
    """
    ok = signals.filter(F.col("liq").isNotNull() & (F.col("n_obs") >= least_obs))
    pool = frames.top_n(ok, [day], [F.col("liq").desc(), F.col("code")], liquid, "__lr").drop("__lr")
    both = pool.filter("mom is not null and vol is not null").withColumn("__m", -F.round("mom", 9)).withColumn("__v", F.round("vol", 9))
    both = both.withColumn("__score", frames.average_rank([day], "__m") + frames.average_rank([day], "__v")).select(day, "code", "__score")
    all_ = pool.join(both, [day, "code"], "left")
    orders = {"momentum": (-F.round("mom", 9), n), "momentum_fewer": (-F.round("mom", 9), fewer), "low_volatility": (F.round("vol", 9), n), "liquidity": (-F.col("liq"), n), "combined": (F.col("__score"), n)}
    each = all_.select(day, "code", F.inline(F.array(*[F.struct(F.lit(k).alias("factor"), o.alias("__o"), F.lit(m).alias("__n")) for k, (o, m) in orders.items()]))).filter("__o is not null")
    return frames.top_n(each, [day, "factor"], [F.col("__o"), F.col("code")], max(n, fewer)).filter("rank <= __n").select(day, "factor", "code", "rank")
