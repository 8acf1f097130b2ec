"""Joins by order, interval and band, and outer and semi joins that tell where a row came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str], *, strict: bool = False) -> DataFrame:
    """left with the values of the last right row at or before left_at (before it, if strict) of the same by; null without one.

    Both sides are put in one order and the last right row is carried on, so that a key is sorted
    once and no pair is formed. Of right rows at one time the greatest by values counts.
    """
    body = F.struct(*[F.col(c) for c in left.columns])
    side = left.select(*by, F.col(left_at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), body.alias("__left"))
    blank = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    side = side.select(*by, "__at", "__side", "__left", F.struct(F.lit(False).alias("__is"), *blank).alias("__right"))
    there = right.filter(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(side.schema["__left"].dataType).alias("__left"), F.struct(F.lit(True).alias("__is"), *[F.col(v) for v in values]).alias("__right"))
    w = Window.partitionBy(*by).orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("__right.__is"), F.col("__right")), ignorenulls=True).over(w)
    both = side.unionByName(there).withColumn("__known", known).filter("__left is not null")
    return both.select("__left.*", *[F.col(f"__known.{v}").alias(v) for v in values])


def as_of_days(left: DataFrame, right: DataFrame, by: Sequence[str], left_day: str, right_day: str, values: Sequence[str]) -> DataFrame:
    """as_of for right sides of a row per day at most: each is spread over the days until the next, and both meet by equality on by and day.

    A key with a third of all left rows is spread by its days, and no row is sorted. Right rows
    per by are as many as calendar days up to the last day of left. Of right rows of one day the
    greatest by values counts.
    """
    one = right.filter(F.col(right_day).isNotNull()).groupBy(*by, F.col(right_day).alias("__from")).agg(F.max(F.struct(*values)).alias("__v"))
    last = left.agg(F.max(left_day).alias("__last"))
    until = F.coalesce(F.date_sub(F.lead("__from").over(Window.partitionBy(*by).orderBy("__from")), 1), F.greatest("__last", "__from"))
    days = one.join(F.broadcast(last)).withColumn("__until", until).select(*by, "__v", F.explode(F.sequence("__from", "__until")).alias(left_day))
    return left.join(days, [*by, left_day], "left").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def in_intervals(rows: DataFrame, periods: DataFrame, by: Sequence[str], day: str, start: str, end: str, name: str = "inside") -> DataFrame:
    """rows with a flag: whether day lies in a period, both ends included, of the same by.

    Periods are spread over their days, distinct, and joined by equality: no range is compared.
    """
    days = periods.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).select(*by, F.explode(F.sequence(start, end)).alias(day)).distinct()
    return rows.join(days.withColumn(name, F.lit(True)), [*by, day], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def band(left: DataFrame, right: DataFrame, by: Sequence[str], left_pos: str, right_pos: str, lo: int, hi: int) -> DataFrame:
    """Pairs of equal by with right_pos within left_pos + lo .. left_pos + hi.

    Positions are cut into cells as wide as the band; a left row asks the cells its band touches,
    two at most three, by equality, so that a key with many rows is spread by cell.
    """
    width = hi - lo + 1
    cell = lambda c: F.floor(c / F.lit(width))
    asked = left.withColumn("__cell", F.explode(F.sequence(cell(F.col(left_pos) + lo), cell(F.col(left_pos) + hi))))
    there = right.withColumn("__cell", cell(F.col(right_pos)))
    return asked.join(there, [*by, "__cell"]).filter(F.col(right_pos).between(F.col(left_pos) + lo, F.col(left_pos) + hi)).drop("__cell")


def near_event(rows: DataFrame, by: Sequence[str], pos: str, event: Column, gap: int, name: str = "near") -> DataFrame:
    """rows with a flag: whether an event of the same by lies within gap positions, the row itself included."""
    w = Window.partitionBy(*by).orderBy(pos).rangeBetween(-gap, gap)
    return rows.withColumn(name, F.coalesce(F.max(event).over(w), F.lit(False)))


def follow_on(events: DataFrame, by: Sequence[str], pos: str, gap: int, name: str = "follows") -> DataFrame:
    """events with a flag: whether the event before of the same by is at most gap positions back."""
    return events.withColumn(name, F.coalesce(F.col(pos) - F.lag(pos).over(Window.partitionBy(*by).orderBy(pos)) <= gap, F.lit(False)))


def outer_with_source(left: DataFrame, right: DataFrame, on: Sequence[str], prefer: Sequence[str]) -> DataFrame:
    """Full outer join with in_left and in_right; columns of prefer, which both have, from the left where it has a value."""
    a = left.withColumn("__l", F.lit(True))
    b = right.select(*on, *[F.col(c).alias(f"__r_{c}") for c in right.columns if c not in on], F.lit(True).alias("__r"))
    j = a.join(b, list(on), "full_outer")
    own = [F.col(c) for c in left.columns if c not in (*on, *prefer)]
    other = [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in (*on, *left.columns)]
    return j.select(*on, *[F.coalesce(c, f"__r_{c}").alias(c) for c in prefer], *own, *other, F.col("__l").isNotNull().alias("in_left"), F.col("__r").isNotNull().alias("in_right"))


def semi_or(rows: DataFrame, ids: DataFrame, key: str, also: Column) -> DataFrame:
    """The rows whose key is among ids, or for which also holds."""
    flag = ids.select(key).distinct().withColumn("__in", F.lit(True))
    return rows.join(flag, key, "left").filter(F.col("__in").isNotNull() | F.coalesce(also, F.lit(False))).drop("__in")


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null equals null."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *values)
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def overnight(sessions: DataFrame, days: DataFrame, window: int = 20) -> DataFrame:
    """(date, abs, neg, pk, lvol, none): what a market that closes between two of days' dates did: of the sessions after the day before's last known one up to the calendar day before.

    sessions: (date, adj, high, low, volume), a row per session. abs and neg are of the summed log
    return, pk the root of the summed Parkinson variances, lvol the last session's log volume
    less its mean over the window before; all 0 with none 1 where no session is new, null before
    the first known ones.
    """
    w = Window.orderBy("date")  # one row per session
    lv = F.when(F.col("volume") > 0, F.log("volume"))
    s = sessions.withColumn("__lv", lv).select(
        F.lit(1).alias("__k"), F.col("date").alias("__at"), F.row_number().over(w).alias("__n"), F.log("adj").alias("__lr"),
        F.sum(F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * F.log(F.lit(2.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__pk"),
        F.when(F.count("__lv").over(w.rowsBetween(-window, -1)) == window, F.col("__lv") - F.avg("__lv").over(w.rowsBetween(-window, -1))).alias("__lvol"),
    )
    seen = as_of(days.select("date").withColumn("__k", F.lit(1)), s, ["__k"], "date", "__at", ["__n", "__lr", "__pk", "__lvol"], strict=True)
    before = lambda c: F.lag(c).over(w)
    d = seen.select("date", "__lvol", F.col("__n").alias("__n1"), before("__n").alias("__n0"), (F.col("__lr") - before("__lr")).alias("__ret"), (F.col("__pk") - before("__pk")).alias("__var"))
    valid, new = F.col("__n0").isNotNull() & F.col("__n1").isNotNull(), F.col("__n1") > F.col("__n0")
    known = lambda c: F.when(valid, F.when(new, c).otherwise(0.0))
    return d.select("date", F.abs(known(F.col("__ret"))).alias("abs"), F.least(known(F.col("__ret")), F.when(valid, 0.0)).alias("neg"), F.sqrt(known(F.greatest("__var", F.lit(0.0)))).alias("pk"), known(F.col("__lvol")).alias("lvol"), F.when(valid, (~new).cast("double")).alias("none"))


def accumulated(source: DataFrame, days: DataFrame, by: Sequence[str], at: str, day: str, value: str) -> DataFrame:
    """(by, day, value, none): the sum of source's value since the previous day of days, up to and without day itself.

    The half-open ranges between successive days are sums of a running total at two as-of
    positions; none tells that no source row fell in between. Null for a by's first day.
    """
    total = source.select(*by, F.col(at).alias("__at"), F.sum(F.coalesce(F.col(value), F.lit(0))).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"), F.row_number().over(Window.partitionBy(*by).orderBy(at)).alias("__n"))
    seen = as_of(days, total, by, day, "__at", ["__sum", "__n"], strict=True)
    w = Window.partitionBy(*by).orderBy(day)
    n, before = F.coalesce("__n", F.lit(0)), F.coalesce(F.lag("__n").over(w), F.lit(0))
    first = F.row_number().over(w) == 1
    return seen.select(*by, day, F.when(~first, F.coalesce("__sum", F.lit(0)) - F.coalesce(F.lag("__sum").over(w), F.lit(0))).alias(value), F.when(~first, n == before).alias("none"))
