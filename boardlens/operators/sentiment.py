"""Scored texts as one figure per day: each account counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.operators.calendar import every_day


def account_means(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, account, m): each account's mean score; texts without account or score don't count.

    Rounded to 12 places, so that a mean of 0 is 0 in whatever order scores are summed.
    """
    return texts.filter("account is not null and score is not null").groupBy(*by, "account").agg(F.round(F.avg("score"), 12).alias("m"))


def sentiment(texts: DataFrame, by: Sequence[str], least_accounts: int = 1) -> DataFrame:
    """(by, sent_mean, bull_ratio, sent_std, n_polar): over accounts' means; null with fewer than least_accounts of them.

    Two aggregations that both combine before they shuffle: a code with a third of all texts
    sends one row per account and task.
    """
    a = account_means(texts, by).groupBy(*by).agg(F.avg("m").alias("sent_mean"), F.avg((F.col("m") > 0).cast("double")).alias("bull_ratio"), F.stddev_pop("m").alias("sent_std"), F.count("*").alias("n_polar"))
    return a.select(*by, *[F.when(F.col("n_polar") >= least_accounts, F.col(c)).alias(c) for c in ("sent_mean", "bull_ratio", "sent_std")], "n_polar")


def day_figures(texts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, trade_date) with texts: counts of articles, comments and accounts, share of pushes among pushes and boos, and the sentiment."""
    keys = [*by, "trade_date"]
    t = texts.filter("trade_date is not null")
    counts = t.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "article").alias("n_articles"),
        F.count_if(F.col("kind") == "comment").alias("n_comments"),
        F.countDistinct("account").alias("n_accounts"),
        F.count_if(F.col("tag") == "push").alias("__push"),
        F.count_if(F.col("tag") == "boo").alias("__boo"),
    )
    counts = counts.withColumn("push_ratio", F.when(F.col("__push") + F.col("__boo") > 0, F.col("__push") / (F.col("__push") + F.col("__boo")))).drop("__push", "__boo")
    return counts.join(sentiment(t, keys), keys, "left")


def daily_sentiment(texts: DataFrame, cal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per trading day (and by): counts of articles, comments and accounts, share of pushes among pushes and boos, and the sentiment.

    texts has trade_date, kind, account, tag and score. Days without texts have counts of 0 and
    no sentiment: no text isn't a neutral one.
    """
    keys = [*by, "trade_date"]
    both = day_figures(texts, by)
    grid = (every_day(texts.select(*by).distinct(), cal) if by else cal).select(*by, F.col("date").alias("trade_date"))
    names = ("n_articles", "n_comments", "n_accounts", "n_polar")
    return grid.join(both, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in names], "push_ratio", "sent_mean", "bull_ratio", "sent_std")
