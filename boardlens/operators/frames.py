"""Frames over ordered rows that give null unless enough figures are in them; ranks and quantile groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: Sequence[str], order: Sequence[str | Column] | str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))


def gated(agg: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """agg over frame, null with fewer than least non-null x in it."""
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def rolling(fn, x: Column, w: WindowSpec, n: int, least: int | None = None, until: int = 0) -> Column:
    """fn(x) over the n rows up to `until` rows from the current one (-1: the rows before it)."""
    return gated(fn(x), x, w.rowsBetween(until - n + 1, until), n if least is None else least)


def expanding(fn, x: Column, w: WindowSpec, least: int, until: int = -1) -> Column:
    return gated(fn(x), x, w.rowsBetween(Window.unboundedPreceding, until), least)


def running(fn, x: Column, w: WindowSpec) -> Column:
    return fn(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def between(total: str, w: WindowSpec, n: int) -> Column:
    """Of a running total the part of the n rows before the current one."""
    return F.coalesce(F.lag(total, 1).over(w), F.lit(0.0)) - F.coalesce(F.lag(total, n + 1).over(w), F.lit(0.0))


def forward_sum(x: Column, w: WindowSpec, h: int) -> Column:
    """Sum of the next h rows' x; null where one is missing, null or beyond the end."""
    return gated(F.sum(x), x, w.rowsBetween(1, h), h)


def rolling_quantile(x: Column, q: float, w: WindowSpec, n: int, least: int) -> Column:
    """The q-quantile, linearly interpolated, of the n rows before."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, F.percentile(x, F.lit(q)).over(frame))


def rolling_quantiles(x: Column, qs: Sequence[float], w: WindowSpec, n: int, least: int) -> Column:
    """rolling_quantile for several q as an array, from one reading of the frame."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, F.percentile(x, F.array(*[F.lit(float(q)) for q in qs])).over(frame))


def abnormal(n: Column, w: WindowSpec, window: int = 20) -> Column:
    """log1p(n) less its mean over the window rows before."""
    return F.log1p(n) - rolling(F.avg, F.log1p(n), w, window, until=-1)


def average_rank(by: Sequence[str], x: str) -> Column:
    """Rank in ascending order, ties sharing the mean of their ranks; null for null."""
    down = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    ties = Window.partitionBy(*by, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(down) + (F.count("*").over(ties) - 1) / 2)


def quantile_group(by: Sequence[str], order: Sequence[Column | str], n: int) -> Column:
    """0 .. n - 1: groups cut at the interpolated quantiles of the row numbers, the lower edge of the first included."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    size = F.count("*").over(Window.partitionBy(*by))
    return F.greatest(F.ceil((k - 1) * n / F.greatest(size - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; planned with a limit per task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def last_known(x: Column, w: WindowSpec, back: int | None = None) -> Column:
    """x, or its last non-null value (of `back` rows before, if given)."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if back is None else -back, 0))


def filled_both_ways(x: Column, w: WindowSpec) -> Column:
    after = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(last_known(x, w), after)


def strict_sum(x: Column) -> Column:
    """Sum in an aggregation that is null where any x is."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def dense_grid(rows: DataFrame, cal: DataFrame, key: str, day: str = "date") -> DataFrame:
    """(key, date, pos): a row for each trading day from a key's first row to its last.

    Expanded per key from positions of the calendar, which is one row per day and broadcast.
    """
    at = rows.join(F.broadcast(cal.select(F.col("date").alias(day), "pos")), day)
    span = at.groupBy(key).agg(F.min("pos").alias("__a"), F.max("pos").alias("__b"))
    every = span.select(key, F.explode(F.sequence("__a", "__b")).alias("pos"))
    return every.join(F.broadcast(cal), "pos").select(key, F.col("date").alias(day), "pos")
