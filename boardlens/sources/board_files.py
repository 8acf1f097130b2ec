"""Archives of board posts: nested lines to articles and comments, and the texts about a stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions import text as tx
from boardlens.operators.joins import outer_with_source

# The keys of the archives' posts, and how the second one marks deleted posts.
_COMMENT = "index: int, time: string, user_id: string, tag_en: string, content: string"
ARTICLE = f"article_id string, date string, author_id string, title string, content string, n_push int, n_boo int, n_arrow int, comments array<struct<{_COMMENT}>>"
WEB = "article_id string, timestamp bigint, title string, body string, pushes array<string>"
DELETED = "已刪文"


def _time(c: Column) -> Column:
    return F.coalesce(c.try_cast("timestamp_ntz"), F.expr("cast(null as timestamp_ntz)"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited posts under a stated schema; posts without date are dropped."""
    return spark.read.schema(ARTICLE).json(path).withColumn("time", _time(F.col("date"))).filter("time is not null and article_id is not null")


def articles(raw: DataFrame) -> DataFrame:
    category, reply = tx.title_category(F.col("title"))
    votes = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_push", "n_boo", "n_arrow")]
    return raw.select("article_id", "time", F.col("author_id").alias("author"), F.coalesce("title", F.lit("")).alias("title"), category.alias("category"), reply.alias("is_reply"), tx.strip_quotes(F.col("content")).alias("content"), *votes, F.year("time").alias("year"))


def comments(raw: DataFrame) -> DataFrame:
    """One row per comment with a time, under its own index; lag_sec from the article."""
    c = raw.select("article_id", F.col("time").alias("__t"), F.explode("comments").alias("c")).withColumn("time", _time(F.col("c.time"))).filter("time is not null")
    lag = F.unix_seconds(F.col("time").cast("timestamp")) - F.unix_seconds(F.col("__t").cast("timestamp"))
    return c.select("article_id", F.col("c.index").alias("idx"), "time", F.col("c.user_id").alias("user"), F.col("c.tag_en").alias("tag"), F.coalesce("c.content", F.lit("")).alias("content"), lag.alias("lag_sec"), F.year("__t").alias("year"))


def write_archive(raw: DataFrame, folder: str) -> None:
    """articles and comments as tables by year; files are replaced as a whole."""
    for name, df in (("articles", articles(raw)), ("comments", comments(raw))):
        df.repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{folder}/{name}")


def texts_about(arts: DataFrame, comms: DataFrame, code: str, aliases: Sequence[str], exclude: Sequence[str] = (), max_lag_days: int = 30) -> DataFrame:
    """(uid, kind, article_id, time, account, text, tag, title, category, n_push, n_boo): articles whose title names the stock, title and content as one text, and comments in their threads or that name it themselves.

    Comments count from 120 seconds before their article to max_lag_days after it; their title and
    category are their article's. Threads are joined by article; the pattern is tried on what the
    join leaves open.
    """
    pattern = tx.mention_pattern(code, aliases)
    titled = arts.withColumn("__in", tx.mentions(F.col("title"), pattern, exclude))
    own = titled.filter("__in").select(F.concat(F.lit("A:"), "article_id").alias("uid"), F.lit("article").alias("kind"), "article_id", "time", F.col("author").alias("account"), F.concat_ws("\n", "title", "content").alias("text"), F.lit(None).cast("string").alias("tag"), "title", "category", "n_push", "n_boo")
    near = comms.filter(F.col("lag_sec").between(-120, max_lag_days * 86400)).join(titled.select("article_id", "title", "category", "__in"), "article_id", "left")
    said = near.filter(F.coalesce("__in", F.lit(False)) | tx.mentions(F.col("content"), pattern, exclude))
    said = said.select(F.concat_ws(":", F.lit("C"), "article_id", "idx").alias("uid"), F.lit("comment").alias("kind"), "article_id", "time", F.col("user").alias("account"), F.col("content").alias("text"), "tag", "title", "category", F.lit(0).alias("n_push"), F.lit(0).alias("n_boo"))
    return own.unionByName(said)


def web_archive(spark: SparkSession, path: str, marker: str = "[標的]") -> DataFrame:
    """(article_id, time, title, body, n_comments) of single-post files of a second archive, titles that begin with marker; a missing time is the second part of the identifier."""
    w = spark.read.schema(WEB).option("multiLine", True).json(path).filter(F.col("title").startswith(marker))
    epoch = F.coalesce(F.nullif("timestamp", F.lit(0)), F.split_part("article_id", F.lit("."), F.lit(2)).try_cast("bigint"))
    return w.select("article_id", F.from_utc_timestamp(F.timestamp_seconds(epoch), "Asia/Taipei").cast("timestamp_ntz").alias("time"), "title", F.coalesce("body", F.lit("")).alias("body"), F.size(F.coalesce("pushes", F.array())).alias("n_comments"))


def target_posts(arts: DataFrame) -> DataFrame:
    """First posts of the category 標的."""
    return arts.filter("category = '標的' and not is_reply").select("article_id", "time", "author", "title", "content", "n_push", "n_boo")


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both archives' posts: time, title and content of the first (target_posts) where it has them, with where each comes from and whether the second marks it as deleted."""
    marked = F.coalesce(F.col("title").contains(DELETED), F.lit(False))
    web = second.select("article_id", "time", F.regexp_replace("title", rf"(?U)\s*{DELETED}\s*$", "").alias("title"), tx.strip_quotes(F.col("body")).alias("content"), marked.alias("deleted"), F.col("n_comments").alias("n_comments_web"))
    both = outer_with_source(first, web, ["article_id"], ["time", "title", "content"])
    return both.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
