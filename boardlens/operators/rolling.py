"""Totals and averages over trailing periods, kept as a versioned daily state.

Of each key and day the state holds the totals over the last n days. It moves by one day as
yesterday's totals plus what arrived today minus what expires, the amounts of n days ago; late
rows change the amount of a past day, and only the dates whose periods hold that day get a new
version. Amounts are exact decimals, so that adding and taking away leaves no rest and any order
and number of corrections gives the same state.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlens.session import drop_table, shared_dir

TOTAL = "decimal(38,6)"
PARTS = ("sum", "n", "nz")
KIND = {"sum": TOTAL, "n": "bigint", "nz": "bigint"}


def block_of(day: Column, block_days: int) -> Column:
    """The number of the block of days that day is in."""
    return F.floor(F.unix_date(day) / F.lit(block_days)).cast("int")


def daily_amounts(rows: DataFrame, keys: Sequence[str], day: str, value: str, identity: Sequence[str] = (), arrived: str | None = None, late_days: int = 1, block_days: int = 1, buckets: int | None = None) -> DataFrame:
    """(keys, day, sum, n, nz, late_sum, late_n, late_nz, late): one row per key and day.

    Rows that agree in keys, identity and day are repeats and count once, at their first arrival.
    sum, n and nz are the total, the number of figures and the number of non-zero figures; the
    late_ columns are the part that arrived more than late_days after the end of the day's block
    of block_days days, late tells whether any row did. A null, NaN or infinite value is no figure, but the day is still one with a row.
    n and nz count the values as they are; only the sums are of decimals. A figure that fits no
    decimal, from 1e32 on, is an error, as no total could hold it.
    Rows with a null key or day are no amounts. Repeats combine before they shuffle, on keys that
    hold the day, so that no key makes a large partition. What is left of a key are its days;
    with buckets they are brought together by key, in that number of partitions, as State keeps them.
    """
    x = F.col(f"`{value}`").try_cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    amount = F.col(f"`{value}`").try_cast(TOTAL)
    amount = F.when(finite.isNotNull(), F.coalesce(amount, F.raise_error(F.concat(F.lit("beyond decimal: "), finite.cast("string"))).cast(TOTAL)))
    src = rows.select(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`").alias(f"__i{i}") for i, c in enumerate(identity)], F.col(f"`{day}`").cast("date").alias("day"), finite.alias("__x"), amount.alias("__v"), (F.col(f"`{arrived}`").cast("timestamp") if arrived else F.lit(None).cast("timestamp")).alias("__at"))
    for c in (*keys, "day"):
        src = src.filter(F.col(f"`{c}`").isNotNull())
    once = src.groupBy(*keys, *[f"__i{i}" for i in range(len(identity))], "day").agg(F.max("__x").alias("__x"), F.max("__v").alias("__v"), F.min("__at").alias("__at"))
    if buckets:
        once = once.repartition(buckets, *keys)
    close = F.date_from_unix_date((block_of(F.col("day"), block_days) + 1) * block_days - 1)
    once = once.withColumn("__late", F.coalesce(F.datediff(F.col("__at").cast("date"), close) > late_days, F.lit(False)))
    x, v, late = F.col("__x"), F.col("__v"), F.col("__late")

    def parts(mine: Column, prefix: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(mine, v)), F.lit(0)).cast(TOTAL).alias(f"{prefix}sum"), F.count(F.when(mine, x)).alias(f"{prefix}n"), F.count(F.when(mine & (x != 0), x)).alias(f"{prefix}nz")]

    return once.groupBy(*keys, "day").agg(*parts(~late, ""), *parts(late, "late_"), F.max("__late").alias("late"))


def _dense(amounts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """amounts with a row for each calendar day from a key's first to its last, without amount where there was none."""
    by = Window.partitionBy(*keys).orderBy("day")
    names = [c for c in amounts.columns if c not in (*keys, "day")]
    until = F.coalesce(F.date_sub(F.lead("day").over(by), 1), F.col("day"))
    ends = amounts.select(*keys, *names, F.col("day").alias("__day"), F.first("day").over(by).alias("first_day"), until.alias("__until"))
    spread = ends.select(*keys, *names, "__day", "first_day", F.explode(F.sequence("__day", "__until")).alias("day"))
    own = F.col("day") == F.col("__day")
    kinds = dict(amounts.dtypes)
    return spread.select(*keys, "day", "first_day", *[F.when(own, F.col(c)).otherwise(F.lit(False if kinds[c] == "boolean" else 0).cast(kinds[c])).alias(c) for c in names])


def rolling_state(amounts: DataFrame, keys: Sequence[str], periods: Sequence[int] = (7, 30), superseded: bool = False) -> DataFrame:
    """The state of all days in one pass: (keys, day, first_day, version, and for each n of periods sum{n}, n{n}, nz{n}).

    amounts is what daily_amounts gives. Version 0 is the state as the rows in time made it;
    dates a late row belongs to are recomputed as version 1, which takes the place of version 0,
    or stands beside it with superseded. Days run without a break from a key's first day with a
    row to its last, late rows included; before the first day there is nothing. Per key one task
    holds at most its calendar days, whatever the number of rows. Every run reads all history:
    this is what a State must agree with, not how one is kept.
    """
    by = Window.partitionBy(*keys).orderBy("day")
    dense = _dense(amounts, keys)
    moved = dense
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    out: list[Column] = []
    for n in periods:
        for p in PARTS:
            for prefix in ("", "late_"):
                change = F.col(f"{prefix}{p}") - F.coalesce(F.lag(f"{prefix}{p}", n).over(by), F.lit(0).cast(KIND[p]))
                moved = moved.withColumn(f"__{prefix}{p}{n}", change.cast(KIND[p]))
            before = F.sum(f"__{p}{n}").over(running)
            out.append(F.struct(before.alias("v0"), (before + F.sum(f"__late_{p}{n}").over(running)).alias("v1")).alias(f"{p}{n}"))
    widest = by.rowsBetween(-(max(periods) - 1), 0)
    state = moved.select(*keys, "day", "first_day", F.max("late").over(widest).alias("__touched"), *out)

    def version(which: int) -> list[Column]:
        return [F.col(f"{p}{n}.v{which}").cast(KIND[p]).alias(f"{p}{n}") for n in periods for p in PARTS]

    if superseded:
        return state.select(*keys, "day", "first_day", F.lit(0).alias("version"), *version(0)).unionByName(state.filter("__touched").select(*keys, "day", "first_day", F.lit(1).alias("version"), *version(1)))
    return state.select(*keys, "day", "first_day", F.col("__touched").cast("int").alias("version"), *version(1))


def advance(days: DataFrame, yesterday: DataFrame, arrivals: DataFrame, expiring: dict[int, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The states of successive days out of the state of the day before the first.

    days: (keys, first_day, day, block), the days to make, without a break for each key; yesterday: one
    state a key; arrivals: (keys, day, sum, n, nz) of those days; expiring: for each n the amounts
    of n days earlier. Joined by key and day, every day's totals are the day's before, and what
    arrives, less what expires. With one day this is advance_day.
    """
    periods, at = sorted(expiring), [*keys, "day"]
    zero = lambda c, p: F.coalesce(F.col(c), F.lit(0).cast(KIND[p]))
    s = days.join(arrivals.select(*at, *[F.col(p).alias(f"__in_{p}") for p in PARTS]).hint("shuffle_hash"), at, "left")
    for n in periods:
        s = s.join(expiring[n].select(*keys, F.date_add("day", n).alias("day"), *[F.col(p).alias(f"__out_{p}{n}") for p in PARTS]).hint("shuffle_hash"), at, "left")
    s = s.join(yesterday.select(*keys, *[F.col(f"{p}{n}").alias(f"__was_{p}{n}") for n in periods for p in PARTS]).hint("shuffle_hash"), list(keys), "left")
    s = s.select(*at, "first_day", "block", *[f"__was_{p}{n}" for n in periods for p in PARTS], *[(zero(f"__in_{p}", p) - zero(f"__out_{p}{n}", p)).cast(KIND[p]).alias(f"__{p}{n}") for n in periods for p in PARTS])
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda p, n: (zero(f"__was_{p}{n}", p) + F.sum(f"__{p}{n}").over(w)).cast(KIND[p]).alias(f"{p}{n}")
    return s.select(*at, "first_day", F.lit(0).alias("version"), *[total(p, n) for n in periods for p in PARTS], "block")


def advance_day(yesterday: DataFrame, arrivals: DataFrame, expiring: dict[int, DataFrame], keys: Sequence[str], day: str) -> DataFrame:
    """The state of day (YYYY-MM-DD) out of yesterday's, keys without arrival included: one step of the recurrence, as a daily job runs it.

    yesterday: the states of the day before; arrivals: daily_amounts of the day; expiring: for
    each n the daily_amounts of the day n days earlier. Three joins on the key of one row per key
    each.
    """
    periods = sorted(expiring)
    today = arrivals.select(*keys, *[F.col(p).alias(f"__in_{p}") for p in PARTS])
    s = yesterday.select(*keys, "first_day", *[f"{p}{n}" for n in periods for p in PARTS]).join(today, list(keys), "full_outer")
    for n in periods:
        s = s.join(expiring[n].select(*keys, *[F.col(p).alias(f"__out_{p}{n}") for p in PARTS]), list(keys), "left")

    def step(p: str, n: int) -> Column:
        x = [F.coalesce(F.col(c), F.lit(0).cast(KIND[p])) for c in (f"{p}{n}", f"__in_{p}", f"__out_{p}{n}")]
        return (x[0] + x[1] - x[2]).cast(KIND[p]).alias(f"{p}{n}")

    d = F.lit(day).cast("date")
    return s.select(*keys, d.alias("day"), F.coalesce("first_day", d).alias("first_day"), F.lit(0).alias("version"), *[step(p, n) for n in periods for p in PARTS])


def correct(state: DataFrame, late: DataFrame, keys: Sequence[str], periods: Sequence[int] = (7, 30)) -> DataFrame:
    """New versions of the dates that late rows belong to, to be appended to state.

    state: one row per key and day, the newest version; late: (keys, day, sum, n, nz), changes of
    amounts of days within the state. Each change reaches the dates up to max(periods) - 1 days on;
    they are summed per key and date before they meet the state.
    """
    widest = max(periods)
    reach = late.select(*keys, *PARTS, F.col("day").alias("__d"), F.explode(F.expr(f"sequence(day, date_add(day, {widest - 1}))")).alias("day"))
    age = F.datediff("day", "__d")
    change = reach.groupBy(*keys, "day").agg(*[F.coalesce(F.sum(F.when(age < n, F.col(p))), F.lit(0)).alias(f"__{p}{n}") for n in periods for p in PARTS])
    new = {f"{p}{n}": (F.col(f"{p}{n}") + F.col(f"__{p}{n}")).cast(KIND[p]) for n in periods for p in PARTS} | {"version": F.col("version") + 1}
    return state.join(change.hint("shuffle_hash"), [*keys, "day"]).select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def newest(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key and day the newest version: the rows that no corrected one comes after."""
    later = state.filter("version > 0").select(*[F.col(c).alias(f"__{c}") for c in (*keys, "day", "version")])
    same = functools.reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in (*keys, "day")])
    return state.join(later.hint("shuffle_hash"), same & (F.col("version") < F.col("__version")), "left_anti")


@dataclass
class State:
    """A rolling state kept in the shared folder, block of days by block of days.

    A block of days is advanced once it is over, with the rows that had arrived by then; rows
    that arrive later are corrections, which give new versions of the dates they reach. Amounts
    and states are tables bucketed by key. The session of its own that reads them lets a join by
    key and day keep that partitioning, so that neither a step nor the reading of the newest
    versions shuffles; what is hashed in memory are a bucket's rows of one block. Blocks of one day are the daily job; a backfill takes long ones, as each
    block is a job of its own.
    """

    spark: SparkSession
    keys: Sequence[str]
    periods: Sequence[int] = (7, 30)
    block_days: int = 128
    buckets: int = 0
    name: str = field(default_factory=lambda: f"rolling_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = shared_dir(self.spark)
        self.own = self.spark.newSession()
        self.own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"):
            self.own.conf.set(k, self.spark.conf.get(k))

    def append(self, rows: DataFrame, table: str) -> None:
        """rows, already partitioned by key into `buckets`, as files of table, a folder for each block."""
        by = rows.write.mode("append").partitionBy("block") if "block" in rows.columns else rows.write.mode("append")
        by.bucketBy(self.buckets, *self.keys).option("path", f"{self.folder}/{table}").option("compression", "zstd").saveAsTable(table)

    def replay(self, amounts: DataFrame) -> DataFrame:
        """All blocks of amounts (of daily_amounts with these block_days and buckets) one after the other, and the newest versions.

        The table of states stays in the shared folder, as a checkpoint does; the others and, after
        a failure, all are dropped.
        """
        a, s, e = f"{self.name}_amounts", f"{self.name}_states", f"{self.name}_ends"
        try:
            self.append(amounts.withColumn("block", block_of(F.col("day"), self.block_days)), a)
            arrived = self.own.table(a)
            self.append(self.spans(arrived), e)
            spans = self.own.table(e)
            first, last = spans.agg(F.min("block"), F.max("block")).first()
            if first is None:
                return self.own.createDataFrame([], self._schema(amounts))
            back = -(-(max(self.periods) - 1) // self.block_days)
            reached = {r[0] + i for r in arrived.filter("late").select("block").distinct().collect() for i in range(back + 1)}  # numbers of blocks
            for b in range(first, last + 1):
                self.step(arrived, spans, s, b, b == first)
                if b in reached:
                    late = arrived.filter(F.col("block").between(b - back, b) & F.col("late")).select(*self.keys, "day", *[F.col(f"late_{p}").alias(p) for p in PARTS])
                    now = self.own.table(s).filter(F.col("block") == b).filter("version = 0")
                    self.append(correct(now, late, self.keys, self.periods), s)
            return newest(self.own.table(s).drop("block"), self.keys)
        except Exception:
            drop_table(self.spark, s)
            raise
        finally:
            drop_table(self.spark, a)
            drop_table(self.spark, e)

    def _schema(self, amounts: DataFrame) -> str:
        kinds = dict(amounts.dtypes)
        return ", ".join([*[f"`{k}` {kinds[k]}" for k in self.keys], "day date, first_day date, version int", *[f"{p}{n} {KIND[p]}" for n in self.periods for p in PARTS]])

    def spans(self, arrived: DataFrame) -> DataFrame:
        """(keys, first_day, from_day, to_day, block): the days each key has in each block, from its first to its last."""
        ends = arrived.groupBy(*self.keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        each = ends.withColumn("block", F.explode(F.sequence(block_of(F.col("first_day"), self.block_days), block_of(F.col("last_day"), self.block_days))))
        begin = F.date_from_unix_date(F.col("block") * self.block_days)
        return each.select(*self.keys, "first_day", F.greatest("first_day", begin).alias("from_day"), F.least("last_day", F.date_add(begin, self.block_days - 1)).alias("to_day"), "block")

    def step(self, arrived: DataFrame, spans: DataFrame, states: str, b: int, first: bool) -> None:
        """Block b: yesterday's totals from the table, joined with what arrives and what expires.

        Which block it is, only the choice of folders says, so that each step runs the code
        compiled for the one before: a row's own block tells the rest, and of the two blocks that
        amounts expire from, those that do in b are the ones whose block then is as even as b.
        """
        k, size = list(self.keys), self.block_days
        days = spans.filter(F.col("block") == b).select(*k, "first_day", "block", F.explode(F.sequence("from_day", "to_day")).alias("day"))
        if first:
            yesterday = spans.filter(F.col("block") == b).select(*k, *[F.lit(None).cast(KIND[p]).alias(f"{p}{n}") for n in self.periods for p in PARTS])
        else:
            yesterday = self.own.table(states).filter(F.col("block") == b - 1).filter((F.col("version") == 0) & (F.unix_date("day") == (F.col("block") + 1) * size - 1))
        some = lambda n: arrived.filter(F.col("block").between(b + -n // size, b + (size - 1 - n) // size))
        expiring = {n: some(n).filter(F.pmod(block_of(F.date_add("day", n), size), F.lit(2)) == b % 2) for n in self.periods}
        self.append(advance(days, yesterday, arrived.filter(F.col("block") == b), expiring, k), states)


def averages(state: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """state with avg{n} over calendar days (total / n) and mean{n} over figures (null without any)."""
    for n in periods:
        state = state.withColumn(f"avg{n}", F.col(f"sum{n}").cast("double") / n).withColumn(f"mean{n}", F.when(F.col(f"n{n}") > 0, F.col(f"sum{n}").cast("double") / F.col(f"n{n}")))
    return state
