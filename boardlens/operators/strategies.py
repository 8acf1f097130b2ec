"""Target weights of rule-based strategies in a one-fold and a two-fold asset, bonds, and what trading them costs.

A strategy is rows of one table: (strategy, date, t_<asset>...), weights null on days without a
wish to trade, as portfolio.weights_backtest takes them. The first day always has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.operators.frames import gated, ordered
from boardlens.operators.portfolio import above_average, level, volatility_target

#: Trading days that carry a band: how far weights may drift before a volatility target trades.
BAND = 0.10


@dataclass(frozen=True)
class Costs:
    """Shares of the money traded: fee before discount, taxes on sales, what borrowing a share costs, and a future's fee and tax."""

    fee: float
    discount: float
    tax: float
    daytrade_tax: float
    fund_tax: float
    borrow: float
    future_fee: float
    future_tax: float

    def stock(self, daytrade: bool = False) -> tuple[float, float, float]:
        """(buy, sell, borrow): a position opened and closed within the day needs no borrowing and pays the lower tax."""
        buy = self.fee * self.discount
        return (buy, buy + self.daytrade_tax, 0.0) if daytrade else (buy, buy + self.tax, self.borrow)

    def future(self) -> tuple[float, float, float]:
        side = self.future_fee + self.future_tax
        return side, side, 0.0

    def fund(self) -> tuple[float, float]:
        buy = self.fee * self.discount
        return buy, buy + self.fund_tax


def two_fold(exposure: Column) -> dict[str, Column]:
    """Weights whose exposure is 1 to 2."""
    return {"x1": 2 - exposure, "x2": exposure - 1}


def period_starts(days: DataFrame, unit: str = "month", date: str = "date") -> Column:
    """The first of days' rows in each month or quarter; the very first too."""
    w = Window.orderBy(date)  # one row per day
    return ~F.date_trunc(unit, date).eqNullSafe(F.date_trunc(unit, F.lag(date).over(w)))


def week_ends(date: str = "date") -> Column:
    """The last of the rows of a Monday-to-Sunday week; the last row of all isn't known to be one, the first row always trades."""
    w = Window.orderBy(date)
    nxt = F.lead(date).over(w)
    return (nxt.isNotNull() & (F.date_trunc("week", date) != F.date_trunc("week", nxt))) | (F.row_number().over(w) == 1)


def signals(days: DataFrame, ret: str, base_vol: float, vol_windows: Sequence[int], average_windows: Sequence[int], factors: Sequence[float]) -> DataFrame:
    """days (date, ret) with above_{n}, whether the level is above its mean over n days (false while unknown), leverage_{n}_{k}, k times base_vol over the volatility of n days within 1 .. 2, and the days to trade on."""
    w = ordered([], "date")  # one series, a row per day
    d = days.withColumn("__level", level(F.col(ret), w))
    out = {f"above_{n}": F.coalesce(above_average(F.col("__level"), w, n), F.lit(False)) for n in average_windows}
    out |= {f"leverage_{n}_{k}": volatility_target(F.col(ret), w, k * base_vol, n) for n in vol_windows for k in factors}
    return d.withColumns({**out, "monthly": period_starts(days), "quarterly": period_starts(days, "quarter"), "weekly": week_ends()}).drop("__level")


@dataclass(frozen=True)
class Rule:
    """exposure (1 to 2) or weights, on the days of when (always if null), traded beyond band."""

    exposure: Column | None = None
    weights: dict[str, Column] | None = None
    when: Column | None = None
    band: float = 0.0


def registered(base_factor: float = 1.5) -> dict[str, Rule]:
    """Buy and hold; half and half by month; volatility target by week; trend by day."""
    vol, up = F.col(f"`leverage_60_{base_factor}`"), F.col("above_200")
    return {
        "C0": Rule(exposure=F.lit(1.0)),
        "C1": Rule(exposure=F.lit(1.5), when=F.col("monthly")),
        "C2": Rule(exposure=vol, when=F.col("weekly"), band=BAND),
        "C3": Rule(exposure=F.when(up, 2.0).otherwise(1.0)),
    }


def variants() -> dict[str, Rule]:
    """The grid around them: fixed exposures, trends with a low of 1 or 1.5, volatility targets, and targets above a trend."""
    up = lambda n: F.col(f"above_{n}")
    rules = {f"fixed_{x}": Rule(exposure=F.lit(x), when=F.col("monthly")) for x in (1.25, 1.5, 1.75, 2.0)}
    rules |= {f"trend_{n}_{low}": Rule(exposure=F.when(up(n), 2.0).otherwise(low)) for n in (100, 150, 200, 250) for low in (1.0, 1.5)}
    rules |= {f"vol_{n}_{k}": Rule(exposure=F.col(f"`leverage_{n}_{k}`"), when=F.col("weekly"), band=BAND) for n in (20, 60, 120) for k in (1.25, 1.5, 1.75)}
    rules |= {f"trend_{n}_vol_{v}": Rule(exposure=F.when(up(n), F.col(f"`leverage_{v}_1.5`")).otherwise(1.0), band=BAND) for n in (150, 200) for v in (20, 60)}
    return rules


def allocations(mixes: dict[str, tuple[dict[str, float], str]]) -> dict[str, Rule]:
    """Fixed weights by name, each put back monthly or quarterly."""
    return {name: Rule(weights={a: F.lit(x) for a, x in weights.items()}, when=F.col(when)) for name, (weights, when) in mixes.items()}


def risk_parity(assets: Sequence[str], n: int = 60) -> Rule:
    """Weights in inverse proportion to the volatility of n days, by month; equal while one is unknown or 0."""
    w = ordered([], "date")
    vol = {a: gated(F.stddev_samp(f"r_{a}"), F.col(f"r_{a}"), w.rowsBetween(1 - n, 0), n) for a in assets}
    inverse = {a: 1 / F.nullif(v, F.lit(0.0)) for a, v in vol.items()}
    total = sum(inverse.values(), F.lit(0.0))
    return Rule(weights={a: F.coalesce(x / total, F.lit(1 / len(assets))) for a, x in inverse.items()}, when=F.col("monthly"))


def targets(days: DataFrame, rules: dict[str, Rule], assets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(strategy, date, keep..., band, t_<asset>): every rule's weights on each of days, null where it doesn't trade; an asset that a rule leaves out has weight 0."""
    d = days.withColumn("__first", F.row_number().over(Window.orderBy("date")) == 1)
    for i, rule in enumerate(rules.values()):
        weights = rule.weights or two_fold(rule.exposure)
        trade = F.lit(True) if rule.when is None else rule.when | F.col("__first")
        d = d.withColumn(f"__w{i}", F.struct(*[F.when(trade, weights.get(a, F.lit(0.0)).cast("double")).alias(f"t_{a}") for a in assets]))
    each = F.array(*[F.struct(F.lit(name).alias("strategy"), F.lit(float(rule.band)).alias("band"), F.col(f"__w{i}").alias("w")) for i, (name, rule) in enumerate(rules.items())])
    return d.select("date", *keep, F.inline(each)).select("strategy", "date", *keep, "band", *[F.col(f"w.t_{a}").alias(f"t_{a}") for a in assets])


def spliced(index: DataFrame, two: DataFrame, funds: DataFrame, switch: str, fee: float, year: int = 365) -> DataFrame:
    """(date, r_x1, r_x2, o_x1, o_x2): before switch the index's return less a yearly fee by calendar days, and the synthetic two-fold one; from switch on those of the funds, not tradable on days without.

    index, two: (date, ret); funds: (date, x1, x2), log returns all.
    """
    w = Window.orderBy("date")
    gap = F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(1))
    d = index.select("date", F.log1p(F.expm1("ret") - fee * gap / F.lit(year)).alias("__1")).join(two.select("date", F.col("ret").alias("__2")), "date", "left").join(funds.select("date", "x1", "x2"), "date", "left")
    real = F.col("date") >= F.lit(switch).cast("date")
    return d.select("date", F.when(real, F.col("x1")).otherwise(F.col("__1")).alias("r_x1"), F.when(real, F.col("x2")).otherwise(F.col("__2")).alias("r_x2"), (~real | F.col("x1").isNotNull()).alias("o_x1"), (~real | F.col("x2").isNotNull()).alias("o_x2"))


def rolling_choice(nets: DataFrame, choice: DataFrame, assets: Sequence[str], cost: float) -> DataFrame:
    """(date, strategy, net): each year the chosen strategy's net returns, less cost on half of the weights that a change of strategy moves on its first day.

    nets: (strategy, date, net, w_<asset>...); choice: (year, strategy).
    """
    own = nets.withColumn("year", F.year("date")).join(F.broadcast(choice), ["year", "strategy"])
    w = Window.orderBy("date")  # one row per day
    moved = sum((F.abs(F.col(f"w_{a}") - F.lag(f"w_{a}").over(w)) for a in assets), F.lit(0.0)) / 2
    new = F.coalesce(F.col("year") != F.lag("year").over(w), F.lit(False))
    return own.withColumn("__paid", F.when(new, moved * cost).otherwise(0.0)).select("date", "strategy", ((1 + F.col("net")) * (1 - F.col("__paid")) - 1).alias("net"))
