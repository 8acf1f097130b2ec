"""Messages delivered more than once: exactly one delivery per identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_DAYS = {"date", "timestamp", "timestamp_ntz"}
_TWO_64 = "18446744073709551616"


def _identifier(key: str) -> Column:
    return F.trim(F.col(f"`{key}`").cast("string"))


def _order(df: DataFrame, time: str, tie: str) -> Column:
    """A value that is smallest for the delivery to keep: the latest, by the greatest tie-break.

    It stands for struct(time, tie). A struct isn't of fixed width, so that Spark would sort for
    min_by; time and tie-break of fixed width are packed into one decimal(38,0), which a hash
    aggregation updates in place. A null time loses to any other, a null tie-break likewise.
    """
    kinds = dict(df.dtypes)
    t, i = F.col(f"`{time}`"), F.col(f"`{tie}`")
    if kinds[time] in _DAYS and kinds[tie] in _WHOLE:
        micros = F.unix_micros(t.cast("timestamp"))
        first = F.coalesce(-micros, F.lit(4 * 10**17)).cast("decimal(38,0)")
        then = F.coalesce(F.bitwise_not(i.cast("bigint")).cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)"))
        return first * F.lit(_TWO_64).cast("decimal(38,0)") + then
    return F.struct(t, i)


def _packed(df: DataFrame, time: str, tie: str) -> bool:
    return dict(df.dtypes)[time] in _DAYS and dict(df.dtypes)[tie] in _WHOLE


def _best(df: DataFrame, what: Column, time: str, tie: str) -> Column:
    return (F.min_by if _packed(df, time, tie) else F.max_by)(what, _order(df, time, tie))


def kept_ids(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(tie): the tie-break value of the delivery to keep of each identifier.

    One hash aggregation by identifier: each map task hands on one candidate per identifier, so an
    identifier with a third of all rows sends no more than one row per task.
    """
    src = df.select(_identifier(key).alias("__key"), F.col(f"`{time}`"), F.col(f"`{tie}`")).filter("__key is not null")
    return src.groupBy("__key").agg(_best(src, F.col(f"`{tie}`"), time, tie).alias(tie)).select(F.col(f"`{tie}`"))


def keep_one(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """df with exactly one row per identifier, and every row whose identifier is null.

    Blanks around the identifier don't count; an empty one is an identifier like any other. Of
    the rows of one identifier the one with the greatest (time, tie) stays, null times and
    tie-breaks being least; of rows equal in both, any one. Other columns may be null, repeated or of any type. An empty table gives an empty one.
    Whole rows aren't aggregated, which would sort them: an identifier's best order is, by hash,
    and the rows meet it by identifier and order, so that no identifier makes a large partition.
    """
    whole = df.select(_identifier(key).alias("__key"), _order(df, time, tie).alias("__order"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")).filter("__key is not null")
    best = whole.groupBy("__key").agg((F.min if _packed(df, time, tie) else F.max)("__order").alias("__order"))
    one = F.row_number().over(Window.partitionBy("__key", "__order").orderBy("__order"))
    kept = whole.join(best, ["__key", "__order"]).withColumn("__n", one).filter("__n = 1").select("__row.*")
    return kept.unionByName(df.filter(F.col(f"`{key}`").isNull()))


def repeats(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The rows of df that keep_one drops; tie must be unique (rows that share it count as one row).

    The join back is on tie, not on the identifier, so that no identifier makes a large partition.
    """
    return df.filter(F.col(f"`{key}`").isNotNull()).join(kept_ids(df, key, time, tie), tie, "left_anti")
