"""Trading calendars: days, positions, and the trading day a time belongs to.

A calendar is (date, pos), one row per trading day, so that it may be broadcast whatever the data:
a century has 25,000 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_days(rows: DataFrame, day: str = "date") -> DataFrame:
    """(date, pos): the distinct days of rows, numbered from 0."""
    days = rows.select(F.col(day).cast("date").alias("date")).filter("date is not null").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def day_map(cal: DataFrame) -> DataFrame:
    """(day, trade_date, pos): each calendar day within cal and the first trading day from it on; of the days before cal the last 30."""
    w = Window.orderBy("date")
    prev = F.coalesce(F.date_add(F.lag("date").over(w), 1), F.date_sub("date", 30))
    spans = cal.select("date", "pos", prev.alias("__from"))
    return spans.select(F.explode(F.sequence("__from", "date")).alias("day"), F.col("date").alias("trade_date"), "pos")


def every_day(keys: DataFrame, cal: DataFrame) -> DataFrame:
    """keys with a row for each trading day, its date and pos; the calendar's length is one number."""
    last = cal.agg(F.max("pos")).first()[0]
    days = F.expr("cast(array() as array<int>)") if last is None else F.sequence(F.lit(0), F.lit(last))
    return keys.withColumn("pos", F.explode(days)).join(F.broadcast(cal), "pos")


def _since_midnight(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 3600 + int(m) * 60


def shifted_day(ts: Column, cutoff: str) -> Column:
    """The day of ts, from cutoff on the next one."""
    return F.date_add(F.to_date(ts), F.when(_since_midnight(ts) >= seconds(cutoff), 1).otherwise(0))


def assign_trade_date(df: DataFrame, ts: str, cal: DataFrame, cutoff: str = "13:30") -> DataFrame:
    """df with trade_date and pos: the first trading day from ts's day on, from cutoff on the next day's; null after the calendar's end.

    All that comes before the calendar, however long before, belongs to its first day.
    """
    m = day_map(cal).withColumnRenamed("day", "__day")
    day, first = shifted_day(F.col(ts), cutoff), cal.agg(F.min("date")).scalar()
    return df.withColumn("__day", F.when(day < first, first).otherwise(day)).join(F.broadcast(m), "__day", "left").drop("__day")


def before_clock(ts: Column, trade_date: Column, clock: str) -> Column:
    """Whether ts lies before clock of trade_date."""
    return F.coalesce((F.to_date(ts) < trade_date) | ((F.to_date(ts) == trade_date) & (_since_midnight(ts) < seconds(clock))), F.lit(False))


def preopen_counts(df: DataFrame, ts: str, cal: DataFrame, start: str | None = None, close: str = "13:30", open_: str = "09:00") -> DataFrame:
    """(date, pos, n): rows from the previous trading day's close to a day's open; 0 without any, null where that time begins before start or has no day before."""
    at = assign_trade_date(df, ts, cal, close).filter("pos is not null")
    n = at.filter(before_clock(F.col(ts), F.col("trade_date"), open_)).groupBy("pos").agg(F.count("*").alias("__n"))
    prev = F.lag("date").over(Window.orderBy("date"))
    days = cal.withColumn("__prev", prev).join(n, "pos", "left")
    known = F.col("__prev").isNotNull() & (F.lit(True) if start is None else F.col("__prev") >= F.lit(start).cast("date"))
    return days.select("date", "pos", F.when(known, F.coalesce("__n", F.lit(0))).alias("n"))


def day_parts(df: DataFrame, ts: str, cal: DataFrame, close: str = "13:30", open_: str = "09:00") -> DataFrame:
    """df's rows within the calendar, with pos and pre: whether they come before the open of that day."""
    at = assign_trade_date(df, ts, cal, close).filter("pos is not null")
    return at.withColumn("pre", before_clock(F.col(ts), F.col("trade_date"), open_))


def period_flags(cal: DataFrame) -> DataFrame:
    """cal with month_end (last trading day of a complete month), week_end, new_month, log_gap, dow, settle and review.

    settle: the month's third Wednesday, or the next trading day within a week of it. review: the
    last trading day there is of each second month of a quarter.
    """
    w = Window.orderBy("date")
    nxt, prev = F.lead("date").over(w), F.lag("date").over(w)
    month, week = (lambda d: F.trunc(d, "MM")), (lambda d: F.trunc(d, "week"))
    third = F.date_add(F.next_day(F.date_sub(F.trunc("date", "MM"), 1), "Wed"), 14)
    out = cal.select(
        "date", "pos",
        F.coalesce(month(nxt) != month(F.col("date")), F.lit(False)).alias("month_end"),
        F.coalesce(week(nxt) != week(F.col("date")), F.lit(False)).alias("week_end"),
        F.coalesce(month(prev) != month(F.col("date")), F.lit(True)).alias("new_month"),
        F.log(F.datediff("date", prev)).alias("log_gap"),
        F.weekday("date").alias("dow"),
        ((F.month("date") % 3 == 2) & (nxt.isNull() | (month(nxt) != month(F.col("date"))))).alias("review"),
        third.alias("__third"),
    )
    settles = out.select("__third").distinct().join(day_map(cal).withColumnRenamed("day", "__third"), "__third").filter(F.datediff("trade_date", "__third") < 7).select(F.col("trade_date").alias("date"), F.lit(True).alias("settle")).distinct()
    return out.drop("__third").join(F.broadcast(settles), "date", "left").withColumn("settle", F.coalesce("settle", F.lit(False)))


def week_key(day: Column) -> Column:
    """The Friday that ends a Saturday-to-Friday week."""
    return F.date_add(F.trunc(F.date_add(day, 2), "week"), 4)
