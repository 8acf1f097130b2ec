"""Series of files whose fields drift: one table out of all, and each change of names and kinds.

A file is a row (feed, seq, fields, data): the names of its fields and rows of cells. Cells are
taken as a map from path (position, then name) to raw value with its kind; kinds are aggregated
per file and path, so that all that follows works on a few rows per file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions.parse import kind_of, number, roc_day
from boardlens.operators.ancestry import inherit


KINDS = ("number", "roc_day", "iso_day", "text")


def _clean_names(fields: Column) -> Column:
    return F.transform(fields, lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), r"[\s　]+", ""))


def _with_before(files: DataFrame) -> DataFrame:
    """files (one row per feed and seq) with __before: the greatest smaller seq of the feed, null for its first file.

    Found within cells of 4,096 seqs, and from the last seqs of the cells where a cell begins, so that no feed is gathered in a task.
    """
    cell = F.floor(F.col("seq") / 4096).alias("__cell")
    seqs = files.select("feed", "seq", cell).filter("feed is not null and seq is not null")
    inside = seqs.withColumn("__in", F.lag("seq").over(Window.partitionBy("feed", "__cell").orderBy("seq")))
    ends = seqs.groupBy("feed", "__cell").agg(F.max("seq").alias("__end"))
    ends = ends.select("feed", "__cell", F.lag("__end").over(Window.partitionBy("feed").orderBy("__cell")).alias("__end"))
    found = inside.join(ends, ["feed", "__cell"]).select("feed", "seq", F.coalesce("__in", "__end").alias("__before"))
    return files.join(found, ["feed", "seq"], "left")


def file_names(files: DataFrame) -> DataFrame:
    """(feed, seq, names): the field names of each file without spaces; a file without names has those of the last earlier one that has.

    names is null where no earlier file has any. Files repeated under a seq count once. Where seqs are missing, a file follows the one with the greatest smaller seq.
    """
    one = files.groupBy("feed", "seq").agg(F.max(_clean_names(F.col("fields"))).alias("names"))
    one = _with_before(one).withColumn("__feed", F.when(F.col("__before").isNotNull(), F.col("feed")))
    return inherit(one, ["feed", "seq"], ["__feed", "__before"], "names")


def cells(files: DataFrame) -> DataFrame:
    """(feed, seq, file_id, row_no, paths): one row per data row, paths a map from position to struct(raw, kind)."""
    rows = files.select("feed", "seq", "file_id", F.posexplode("data").alias("row_no", "__row"))
    return rows.select("feed", "seq", "file_id", "row_no", F.map_from_entries(F.transform(F.coalesce("__row", F.expr("cast(array() as array<string>)")), lambda v, i: F.struct(i.alias("key"), F.struct(v.alias("raw"), kind_of(v).alias("kind")).alias("value")))).alias("paths"))


def path_kinds(files: DataFrame) -> DataFrame:
    """(feed, seq, pos, kind, n_values, n_kinds): the kind of each path's values in each file.

    Null without a value; text where values of several kinds meet, the only kind that holds them all.
    """
    known = F.array(*[F.lit(k) for k in KINDS])
    rows = files.select("feed", "seq", F.explode("data").alias("__row")).filter(F.size("__row") > 0)
    paths = rows.select("feed", "seq", F.map_from_arrays(F.sequence(F.lit(0), F.size("__row") - 1), F.col("__row")).alias("__paths"))
    flat = paths.select("feed", "seq", F.explode("__paths").alias("pos", "raw")).withColumn("__kind", kind_of(F.col("raw")))
    flat = flat.select("feed", "seq", "pos", F.when(F.col("__kind").isNotNull(), F.array_position(known, F.col("__kind"))).alias("__k"))  # numbers, so that hashing aggregates them
    per = flat.groupBy("feed", "seq", "pos").agg(F.count("__k").alias("n_values"), F.min("__k").alias("__lo"), F.max("__k").alias("__hi"))
    kind = F.when(F.col("__lo") == F.col("__hi"), F.element_at(known, F.col("__lo").cast("int"))).when(F.col("__lo").isNotNull(), "text")
    return per.select("feed", "seq", "pos", kind.alias("kind"), "n_values", F.when(F.col("__lo") != F.col("__hi"), 2).otherwise(F.col("__lo").isNotNull().cast("int")).alias("n_kinds"))


def name_changes(names: DataFrame) -> DataFrame:
    """(feed, seq, before_seq, field, before, change) of each file against the preceding one, the one with the greatest smaller seq.

    change is kept (before = field), renamed (before = the old name), added or removed. A name is
    renamed if it stands where a lost one stood and both files have as many fields.
    """
    before = names.select("feed", F.col("seq").alias("before_seq"), F.col("names").alias("old")).filter("old is not null")
    both = _with_before(names).withColumnRenamed("__before", "before_seq").filter("names is not null").join(before, ["feed", "before_seq"]).withColumn("__even", F.expr("size(names) = size(old)"))
    field = "named_struct('field', {}, 'before', {}, 'change', {})"
    now = f"""transform(names, (n, i) -> case when array_contains(old, n) then {field.format('n', 'n', "'kept'")}
        when __even and not array_contains(names, get(old, i)) then {field.format('n', 'get(old, i)', "'renamed'")}
        else {field.format('n', 'cast(null as string)', "'added'")} end)"""
    lost = f"""transform(filter(old, (n, i) -> not array_contains(names, n) and not (__even and not array_contains(old, get(names, i)))), n -> {field.format('n', 'n', "'removed'")})"""
    return both.select("feed", "seq", "before_seq", F.explode(F.expr(f"concat({now}, {lost})")).alias("__c")).select("feed", "seq", "before_seq", "__c.*").distinct()


def changes(files: DataFrame) -> DataFrame:
    """(feed, seq, field, change): every renamed, added, removed and retyped field, one row each.

    retyped compares a field's kind with that in the last earlier file with a value in it, through
    renaming but not across removal; no-value cells have no kind. A file without names has those
    of the preceding file; one without data has no kinds. Of two equal names in a file the first
    counts. Files with null feed or seq belong to no series and give nothing; null data is empty, extra columns change nothing. Everything is joined on (feed, seq, ...): a feed with a third of all files is spread
    like any other.
    """
    names = file_names(files)
    steps = name_changes(names)
    nodes = names.select("feed", "seq", F.posexplode("names").alias("pos", "field")).join(path_kinds(files).select("feed", "seq", "pos", "kind"), ["feed", "seq", "pos"], "left")
    nodes = nodes.groupBy("feed", "seq", "field").agg(F.min_by("kind", "pos").alias("own"))
    links = steps.filter("change in ('kept', 'renamed')").select("feed", "seq", "field", "before_seq", "before")
    nodes = nodes.join(links, ["feed", "seq", "field"], "left")
    chain = nodes.select("feed", "seq", "field", "own", F.when(F.col("before").isNotNull(), F.col("feed")).alias("__pf"), F.col("before_seq").alias("__ps"), F.col("before").alias("__pn"))
    known = inherit(chain, ["feed", "seq", "field"], ["__pf", "__ps", "__pn"], "own")
    earlier = known.select("feed", F.col("seq").alias("before_seq"), F.col("field").alias("before"), F.col("own").alias("was"))
    retyped = nodes.filter("own is not null and before is not null").join(earlier, ["feed", "before_seq", "before"]).filter("was != own").select("feed", "seq", "field", F.lit("retyped").alias("change"))
    return steps.filter("change != 'kept'").select("feed", "seq", "field", "change").unionByName(retyped)


@dataclass(frozen=True)
class Target:
    """A column of the common table: its kind (number, day or text) and the names it goes by."""

    name: str
    kind: str
    known_as: tuple[str, ...]


def common_table(files: DataFrame, targets: list[Target]) -> DataFrame:
    """(feed, seq, row_no, one typed column per target, failed, rest): all data rows of all files in one table.

    failed lists the targets whose cell holds a value that isn't of the target's kind; the column
    is null there. rest holds each value that is in no column, as (pos, name, raw): those of names
    that no target goes by, those that failed, those of a second name of the same target, and those
    beyond the names (name is null there). pos counts from 1. It is an array, as names may be
    repeated or missing. So each value of a row is in a column or in rest. Of files repeated under a seq the one with the least file_id is taken, once.
    """
    first = files.groupBy("feed", "seq").agg(F.min("file_id").alias("file_id"))
    rows = cells(files).join(first, ["feed", "seq", "file_id"], "left_semi").dropDuplicates(["feed", "seq", "row_no"]).join(file_names(files), ["feed", "seq"])
    raws: list[Column] = []
    places: list[Column] = []
    for i, t in enumerate(targets):
        at = F.coalesce(*[F.nullif(F.array_position("names", n), F.lit(0)) for n in t.known_as])
        cell = F.when(at.isNotNull(), F.try_element_at("paths", (at - 1).cast("int")))
        raws.append(F.when(cell["kind"].isNotNull(), cell["raw"]).alias(f"__raw{i}"))
        places.append((at - 1).cast("int").alias(f"__at{i}"))
    rows = rows.select("feed", "seq", "row_no", "names", "paths", *raws, *places)
    # one array per kind, as the code of each cast, once per target, would be more than Spark compiles
    cast = {"number": number, "day": lambda x: F.coalesce(roc_day(x), x.try_cast("date")), "text": lambda x: x}
    of = {k: [i for i, t in enumerate(targets) if t.kind == k] for k in cast}
    rows = rows.withColumns({f"__{k}": F.transform(F.array(*[F.col(f"__raw{i}") for i in of[k]]), cast[k]) for k in of if of[k]})
    out: list[Column] = []
    failed: list[Column] = []
    for i, t in enumerate(targets):
        out.append(F.get(f"__{t.kind}", F.lit(of[t.kind].index(i))).alias(t.name))
        if t.kind != "text":
            failed.append(F.when(F.col(f"__raw{i}").isNotNull() & F.col(t.name).isNull(), F.lit(t.name)))
    typed_rows = rows.select("feed", "seq", "row_no", "names", "paths", *[f"__{k}{i}" for k in ("raw", "at") for i in range(len(targets))], *out)
    held = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(F.col(t.name).isNotNull(), F.col(f"__at{i}")) for i, t in enumerate(targets)]))
    left = F.filter(F.map_entries("paths"), lambda e: e["value"]["kind"].isNotNull() & ~F.array_contains(held, e["key"]))
    rest = F.transform(left, lambda e: F.struct((e["key"] + 1).alias("pos"), F.get("names", e["key"]).alias("name"), e["value"]["raw"].alias("raw")))
    return typed_rows.select("feed", "seq", "row_no", *[t.name for t in targets], F.array_compact(F.array(*failed)).alias("failed"), rest.alias("rest"))
