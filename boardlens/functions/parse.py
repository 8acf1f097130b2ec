"""Tolerant and strict readings of exchange text: numbers, ROC days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms in exchange files.
NO_VALUE = ("", "-", "--", "---")
_PLAIN = r"\A(?:[0-9]++|[0-9]{1,3}(?:,[0-9]{3})++)(?:\.[0-9]++)?\z"
_ROC = r"\A([0-9]{1,3})(?:/([0-9]{1,2})/([0-9]{1,2})|年([0-9]{1,2})月([0-9]{1,2})日)\z"


def plain_number_ok(x: Column) -> Column:
    """Whether x is empty, --, --- or a plain number with or without commas before groups of three."""
    return x.isin("", "--", "---") | x.rlike(_PLAIN)


def number(x: Column) -> Column:
    """x as double, commas dropped; null for no-value marks and whatever isn't a number."""
    t = F.replace(F.trim(x), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"\A[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z"), t).try_cast("double")


def _roc_parts(x: Column) -> tuple[Column, Column, Column]:
    def part(*groups: int) -> Column:
        return F.concat(*[F.regexp_extract(x, _ROC, g) for g in groups])

    return tuple(p.try_cast("int") for p in (part(1), part(2, 4), part(3, 5)))


def roc_day(x: Column) -> Column:
    """x, y/m/d or y年m月d日 in ROC years, as date; null for whatever isn't a real day."""
    y, m, d = _roc_parts(x)
    first = F.when((y >= 1) & m.between(1, 12), F.make_date(y + 1911, m, F.lit(1)))
    return F.when(d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, d - 1))


def roc_day_ok(x: Column) -> Column:
    return roc_day(x).isNotNull()


def kind_of(x: Column) -> Column:
    """number, roc_day, iso_day or text; null for null and no-value marks."""
    return (
        F.when(x.isNull() | F.trim(x).isin("", "-", "--"), None)
        .when(x.rlike(r"\A[0-9,]*+(?:\.[0-9,]*+)?\z") & x.rlike("[0-9]"), "number")
        .when(x.rlike(_ROC), "roc_day")
        .when(x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "iso_day")
        .otherwise("text")
    )
