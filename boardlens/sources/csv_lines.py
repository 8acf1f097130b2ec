"""Lines of delimited files: the rows that can be read, and the others with the reason.

The lines are read permissively under one explicit schema that keeps the raw text of those that
don't fit. What is set aside, and whatever holds a quote (the reader is lenient about quotes), is
then classed by strict checks: quoting, number of columns, values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.functions.parse import plain_number_ok, roc_day_ok

# The strict form of a line; possessive, so that no length of line exhausts the stack.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_LINE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


@dataclass(frozen=True)
class Feed:
    """What the values of a feed must be. numbers, days: names of columns; span: a first and a last name, all columns between which are numbers."""

    numbers: tuple[str, ...] = ()
    days: tuple[str, ...] = ()
    span: tuple[str, str] | None = None


def quoting_ok(raw: Column) -> Column:
    return raw.rlike(_LINE)


def strict_fields(raw: Column) -> Column:
    """The fields of a line whose quoting is right, without quotes; an empty line is one empty field."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(f",({_FIELD})"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def classify_lines(lines: DataFrame, feeds: dict[str, Feed]) -> DataFrame:
    """lines (line_id, feed, file, line_no, raw, ...) without headers, with names, fields and reason.

    The header, line 1 of a file, names the columns of its file. reason is null for a good row,
    else the first that holds of quoting, column_count and value. names and fields are arrays of
    equal length in good rows; fields is null where quoting is broken. A null raw is an empty
    line. Only line 1 is a header: a line whose line_no is null or below 1 is classed under its
    file's header like any other. In a file without a header, or with one whose quoting is broken, each line is a case of
    column_count. Values of feeds not in feeds aren't checked. Extra columns are kept, but for
    ones called names, fields or reason, which give way.

    Headers are joined to lines by file; a file with a third of all lines is split by adaptive
    skew handling, as the join is followed by no other exchange.
    """
    lines = lines.drop("names", "fields", "reason")
    head = (
        lines.filter("line_no = 1")
        .select(F.col("feed").alias("__feed"), F.col("file").alias("__file"), F.coalesce("raw", F.lit("")).alias("__raw"))
        .groupBy("__feed", "__file")
        .agg(F.min("__raw").alias("__raw"))
        .filter(quoting_ok(F.col("__raw")))
        .select("__feed", "__file", F.transform(strict_fields(F.col("__raw")), F.trim).alias("names"))
    )
    width = head.agg(F.max(F.size("names"))).first()[0] or 1  # one number
    body = lines.filter("not (line_no <=> 1)").withColumn("__text", F.coalesce("raw", F.lit("")))
    body = body.join(head, F.col("feed").eqNullSafe(F.col("__feed")) & F.col("file").eqNullSafe(F.col("__file")), "left").drop("__feed", "__file")
    # A blank line passes for a row of nulls, so it counts as set aside.
    # Padding each line by the columns that its file lacks lets one schema hold for all files: a line fits if its own number of columns is right.
    padded = F.concat("__text", F.repeat(F.lit(","), F.lit(width) - F.coalesce(F.size("names"), F.lit(width))))
    schema = ", ".join(f"c{i} string" for i in range(width)) + ", __corrupt string"
    read = body.withColumn("__csv", F.from_csv(padded, F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(width + 16, 20480))}))
    clean = F.col("__csv").isNotNull() & F.col("__csv.__corrupt").isNull() & ~F.col("__text").contains('"') & (F.trim("__text") != "") & F.col("names").isNotNull()
    fields = F.when(clean, F.slice(F.array(*[F.coalesce(F.col(f"__csv.c{i}"), F.lit("")) for i in range(width)]), F.lit(1), F.size("names"))).when(quoting_ok(F.col("__text")), strict_fields(F.col("__text")))
    read = read.withColumn("fields", fields).withColumn("__clean", clean)
    bad_value = F.lit(False)
    for name, feed in feeds.items():
        bad_value = F.when(F.col("feed") == name, _bad_value(feed)).otherwise(bad_value)
    reason = (
        F.when(F.col("fields").isNull(), "quoting")
        .when(~F.col("__clean") & F.coalesce(F.size("fields") != F.size("names"), F.lit(True)), "column_count")
        .when(bad_value, "value")
    )
    return read.select(*[F.col(f"`{c}`") for c in lines.columns], "names", "fields", reason.alias("reason"))


def _bad_value(feed: Feed) -> Column:
    names = F.col("names")
    first, last = (F.array_position(names, n) for n in feed.span) if feed.span else (F.lit(0), F.lit(-1))
    number = F.array(*[F.lit(n) for n in feed.numbers]) if feed.numbers else F.expr("cast(array() as array<string>)")
    day = F.array(*[F.lit(n) for n in feed.days]) if feed.days else F.expr("cast(array() as array<string>)")

    def bad(pair: Column) -> Column:
        at, name, value = pair["at"] + 1, pair["names"], pair["fields"]
        is_number = F.array_contains(number, name) | ((first > 0) & (at >= first) & (at <= last))
        return (is_number & ~plain_number_ok(value)) | (F.array_contains(day, name) & ~roc_day_ok(value))

    return F.exists(F.arrays_zip(F.sequence(F.lit(0), F.size(names) - 1).alias("at"), names.alias("names"), F.col("fields").alias("fields")), bad)


def good_rows(classified: DataFrame) -> DataFrame:
    """The good rows with their values as a map from name to text; a name that occurs twice keeps its first value."""
    first = F.array_distinct("names")
    return classified.filter("reason is null").withColumn("values", F.map_from_arrays(first, F.transform(first, lambda n: F.element_at("fields", F.array_position("names", n).cast("int"))))).drop("names", "fields", "reason")


def bad_lines(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is not null").drop("names", "fields")
