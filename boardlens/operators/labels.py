"""Answers of labelling services as tables: parsing, counts, cost, timing, evidence lines. The services themselves are behind an interface."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.operators.frames import top_n


class Provider(Protocol):
    """A labelling service: takes requests (id, prompt), gives (id, stop, answer, usage...)."""

    def label(self, requests: DataFrame) -> DataFrame: ...


def parse_answers(answers: DataFrame, answer: str, stop: str, schema: str) -> DataFrame:
    """answers with the answer's fields and status: refusal, max_tokens, bad_json or ok; fields are null unless ok."""
    parsed = F.from_json(answer, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    d = answers.withColumn("__p", parsed)
    broken = F.col("__p").isNull() | F.col("__p.__bad").isNotNull() | F.col(answer).isNull()
    status = F.when(F.col(stop) == "refusal", "refusal").when(F.col(stop) == "max_tokens", "max_tokens").when(broken, "bad_json").otherwise("ok")
    names = [f for f in d.schema["__p"].dataType.names if f != "__bad"]
    d = d.withColumn("status", status)
    return d.select(*answers.columns, "status", *[F.when(F.col("status") == "ok", F.col(f"__p.{n}")).alias(n) for n in names])


def label_counts(labeled: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, status, label, n, share): share among the ok ones."""
    n = labeled.groupBy(*by, "status", label).agg(F.count("*").alias("n"))
    ok = labeled.filter("status = 'ok'").groupBy(*by).agg(F.count("*").alias("__t")) if by else None
    total = F.col("__t") if by else F.lit(labeled.filter("status = 'ok'").count())
    j = n.join(ok, list(by), "left") if by else n
    return j.select(*by, "status", label, "n", F.when(F.col("status") == "ok", F.col("n") / F.nullif(total, F.lit(0))).alias("share"))


def usage_cost(labeled: DataFrame, model: str, prices: dict[str, dict[str, float]], half_price: bool = False) -> DataFrame:
    """(model, n, one column of tokens per kind, cost): prices per million tokens by model and kind; cost is null for models without prices."""
    kinds = sorted({k for p in prices.values() for k in p})
    sums = labeled.groupBy(model).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in kinds])
    cost = F.lit(None).cast("double")
    for name, p in prices.items():
        total = sum((F.col(k) * F.lit(p.get(k, 0.0)) for k in kinds), F.lit(0.0)) / 1_000_000 * (0.5 if half_price else 1.0)
        cost = F.when(F.col(model) == name, total).otherwise(cost)
    return sums.withColumn("cost", cost)


def nearest_items(items: DataFrame, event: str, distance: Column, caps: dict[str, int], source: str = "source", tie: str = "item_id") -> DataFrame:
    """Per event and source the items with the least distance, at most caps[source] of them, numbered by time as N1, N2, ... within the source's letter."""
    cap = F.lit(0)
    for s, n in caps.items():
        cap = F.when(F.col(source) == s, n).otherwise(cap)
    near = top_n(items.withColumn("__d", distance), [event, source], [F.col("__d"), F.col(tie)], max(caps.values()), "__k").filter(F.col("__k") <= cap)
    return near.selectExpr("*", f"concat(upper(substr({source}, 1, 1)), row_number() over (partition by {event}, {source} order by time, {tie})) as item_no").drop("__d", "__k")


def evidence(items: DataFrame, event: str, line: Column) -> DataFrame:
    """(event, evidence): each event's lines in the order of time, one text; items are at most as many as nearest_items leaves."""
    rows = items.select(event, F.struct("time", "item_no", line.alias("line")).alias("r"))
    return rows.groupBy(event).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("evidence"))


def item_line() -> Column:
    """[number] month-day hour:minute source: text."""
    return F.concat(F.lit("["), "item_no", F.lit("] "), F.date_format("time", "MM-dd HH:mm"), F.lit(" "), "source", F.lit(": "), "text")


def earliest_cause(labeled: DataFrame, items: DataFrame, event: str, ids: str = "cause_ids") -> DataFrame:
    """(event, first): the time of the earliest item that an event's labels name; null without any that is known."""
    named = labeled.select(event, F.explode_outer(ids).alias("item_no"))
    return named.join(items.select(event, "item_no", "time"), [event, "item_no"], "left").groupBy(event).agg(F.min("time").alias("first"))


def timing(first: Column, day: Column, open_: str = "09:00", close: str = "13:30") -> Column:
    """none, before (the open), intraday (up to the close) or after."""
    at = lambda clock: (F.date_format(day, "yyyy-MM-dd ").cast("string"), clock)
    o, c = (F.concat(p, F.lit(x)).cast("timestamp_ntz") for p, x in (at(open_), at(close)))
    return F.when(first.isNull(), "none").when(first < o, "before").when(first <= c, "intraday").otherwise("after")


def stratified(df: DataFrame, by: Sequence[str], kind: str, sizes: dict[str, int], order: Sequence[str]) -> DataFrame:
    """Of each group of by and kind the first sizes[kind] rows by order; kinds without a size have none."""
    size = F.lit(0)
    for k, n in sizes.items():
        size = F.when(F.col(kind) == k, n).otherwise(size)
    return top_n(df, [*by, kind], [F.col(c) for c in order], max(sizes.values()), "__k").filter(F.col("__k") <= size).drop("__k")


def check_sheet(hits: DataFrame, by: Sequence[str], order: Column, n: int = 30) -> DataFrame:
    """hits with n_hits: of each group at most n to be checked by hand, the first by order, such as a hash of the row."""
    total = hits.groupBy(*by).agg(F.count("*").alias("n_hits"))
    return top_n(hits, by, [order], n, "__k").drop("__k").join(total, list(by))


def recheck_sheet(hits: DataFrame, seen: DataFrame, by: Sequence[str], item: str, order: Column, n: int = 30) -> DataFrame:
    """hits with n_hits and from_first: groups of up to n hits whole, those that the first sheet (seen: by and item) held marked; of larger ones n that it didn't."""
    marked = hits.join(seen.select(*by, item).distinct().withColumn("__s", F.lit(1)), [*by, item], "left")
    d = marked.join(hits.groupBy(*by).agg(F.count("*").alias("n_hits")), list(by)).withColumn("from_first", F.col("__s").isNotNull().cast("int")).drop("__s")
    few = d.filter(F.col("n_hits") <= n)
    many = top_n(d.filter((F.col("n_hits") > n) & (F.col("from_first") == 0)), by, [order], n, "__k").drop("__k")
    return few.unionByName(many)


def carried_marks(second: DataFrame, first: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """second with ok of the rows that from_first marks taken from first, where the same item was checked."""
    known = first.groupBy(*by, item).agg(F.max("ok").alias("__ok"))
    return second.join(known, [*by, item], "left").withColumn("ok", F.when(F.col("from_first") == 1, F.col("__ok")).otherwise(F.col("ok"))).select(*second.columns)


def name_precision(checks: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(code, kind, precision, n): the share of checked hits that are right; a code and kind's latest round counts. gone: (code, kind) that a later round found nothing of any more, which have no precision."""
    per = checks.filter("ok is not null").groupBy("code", "kind", "round").agg(F.avg(F.col("ok").cast("double")).alias("precision"), F.count("*").alias("n"))
    last = per.groupBy("code", "kind").agg(F.max_by(F.struct("precision", "n"), "round").alias("r")).select("code", "kind", "r.*")
    if gone is None:
        return last
    j = last.join(gone.select("code", "kind").distinct().withColumn("__g", F.lit(1)), ["code", "kind"], "left")
    return j.select("code", "kind", F.when(F.col("__g").isNull(), F.col("precision")).alias("precision"), F.when(F.col("__g").isNull(), F.col("n")).otherwise(0).alias("n"))


def hit_stats(tagged: DataFrame, named: DataFrame) -> DataFrame:
    """(code, hits, tagged_hits, tags, tag_frac): items whose title names a code, how many of them are also tagged with it, and all tagged ones. Both sides are (item, code), distinct."""
    both = named.withColumn("__n", F.lit(1)).join(tagged.withColumn("__t", F.lit(1)), ["item", "code"], "full_outer")
    g = both.groupBy("code").agg(F.count("__n").alias("hits"), F.count(F.when(F.col("__n").isNotNull() & F.col("__t").isNotNull(), 1)).alias("tagged_hits"), F.count("__t").alias("tags"))
    return g.withColumn("tag_frac", F.col("tagged_hits") / F.nullif(F.col("hits"), F.lit(0)))
