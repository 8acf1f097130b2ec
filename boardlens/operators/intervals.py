"""Overlapping and gapped integer intervals, by dyadic blocks.

A block (level, at) stands for the 2^level positions from at * 2^level. An interval is a union of
at most two blocks per level; whether a block lies in another, and whether its sibling is there,
is a question of equal keys, so that both are hash joins and aggregations on (key, level, at): a
key with a third of all rows is spread over all partitions. What is left of a key then are disjoint
blocks, as many as its positions allow, whatever its rows; they are brought together once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(df: DataFrame, keys: Sequence[str], start: str, end: str, levels: int) -> DataFrame:
    """(keys, __lvl, __at): the distinct canonical blocks of df's intervals [start, end], both included."""
    left = f"-shiftright(-`{start}`, k)"
    right = f"shiftright(`{end}` + 1, k)"
    below = F.expr(
        f"""flatten(transform(sequence(0, {levels - 1}), k -> filter(array(
              if({left} < {right} and ({left} & 1) = 1, named_struct('__lvl', k, '__at', {left}), null),
              if({left} < {right} and ({right} & 1) = 1, named_struct('__lvl', k, '__at', {right} - 1), null)), b -> b is not null)))"""
    )
    top_left, top_right = left.replace(", k)", f", {levels})"), right.replace(", k)", f", {levels})")
    top = F.expr(f"if({top_left} < {top_right}, transform(sequence({top_left}, {top_right} - 1), i -> named_struct('__lvl', {levels}, '__at', i)), array())")
    return df.select(*keys, F.explode(F.concat(below, top)).alias("__b")).select(*keys, "__b.*").distinct()


def without_covered(b: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """b without the blocks that lie in another one of the same key."""
    asked = b.select(*keys, F.col("__lvl").alias("__lvl0"), F.col("__at").alias("__at0"), F.explode(F.expr(f"if(__lvl < {levels}, transform(sequence(__lvl + 1, {levels}), k -> named_struct('__lvl', k, '__at', shiftright(__at, k - __lvl))), array())")).alias("__up"))
    covered = (
        asked.select(*keys, "__lvl0", "__at0", "__up.*")
        .join(b, [*keys, "__lvl", "__at"], "left_semi")
        .select(*keys, F.col("__lvl0").alias("__lvl"), F.col("__at0").alias("__at"))
        .distinct()
    )
    return b.join(covered, [*keys, "__lvl", "__at"], "left_anti")


def merge_siblings(b: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """b, whose blocks are disjoint, with each pair of siblings replaced by their parent, from the lowest level up; b is partitioned by keys once, for all levels."""
    b = b.repartition(*keys)
    for k in range(levels):
        rising = F.col("__lvl") == k
        up = b.groupBy(*keys, F.when(rising, k + 1).otherwise(F.col("__lvl")).alias("__up"), F.when(rising, F.shiftright("__at", 1)).otherwise(F.col("__at")).alias("__to"), rising.alias("__rising")).agg(F.count("*").alias("__n"), F.min("__at").alias("__child"))
        alone = F.col("__rising") & (F.col("__n") == 1)
        b = up.select(*keys, F.when(alone, k).otherwise(F.col("__up")).cast("int").alias("__lvl"), F.when(alone, F.col("__child")).otherwise(F.col("__to")).alias("__at"))
    return b


def periods(df: DataFrame, keys: Sequence[str], start: str, end: str, levels: int = 16) -> DataFrame:
    """(keys, start, end): per key the longest runs of positions that lie in df's intervals.

    start and end are integer columns, both included. Intervals that touch (end + 1 = start) form
    one run. Rows with a null start or end, or end before start, are ignored; a null key is a key;
    repeated rows and extra columns change nothing. levels bounds the largest block, not the
    intervals: longer ones consist of several blocks. What reaches one task in the last steps are
    the disjoint blocks of one key, not its rows: at most two per level and interval left.
    """
    src = df.select(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{k}`").isNull().alias(f"__n{i}") for i, k in enumerate(keys)], *[F.col(f"`{k}`").alias(f"__v{i}") for i, k in enumerate(keys)], F.col(f"`{start}`").cast("bigint").alias("__s"), F.col(f"`{end}`").cast("bigint").alias("__e"))
    ks = [x for i in range(len(keys)) for x in (f"__k{i}", f"__n{i}")]
    b = blocks(src.filter("__s is not null and __e is not null and __s <= __e").select(*ks, "__s", "__e"), ks, "__s", "__e", levels)
    b = merge_siblings(without_covered(b, ks, levels), ks, levels)
    runs = b.select(*ks, F.expr("shiftleft(__at, __lvl)").alias("__s"), F.expr("shiftleft(__at + 1, __lvl) - 1").alias("__e"))
    by = Window.partitionBy(*ks).orderBy("__s")
    marked = runs.withColumn("__new", F.when(F.col("__s") == F.lag("__e").over(by) + 1, 0).otherwise(1))
    grouped = marked.withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*ks, "__run").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    kinds = dict(df.dtypes)
    return grouped.select(*[F.expr(f"if(__n{i}, null, __k{i})").cast(kinds[k]).alias(k) for i, k in enumerate(keys)], F.col("__s").alias(start), F.col("__e").alias(end))


def with_gaps(runs: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, kind, start, end): the runs as kind period and, from the same rows, what gaps gives as kind gap."""
    named = runs.withColumn("__after", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))
    after = F.col("__after")
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias(start), b.alias(end))
    both = F.array(part("period", F.col(start), F.col(end)), F.when(after.isNotNull(), part("gap", F.col(end) + 1, after - 1)))
    return named.select(*keys, F.inline(F.array_compact(both)))


def gaps(runs: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): the positions strictly between two successive runs of a key."""
    by = Window.partitionBy(*keys).orderBy(start)
    return runs.select(*keys, (F.col(end) + 1).alias(start), (F.lead(start).over(by) - 1).alias(end)).filter(F.col(end).isNotNull())
