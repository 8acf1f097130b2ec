"""Queries p3, p7, p8 and p9, with SQL where there is one that ends on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import canonical, contamination, packing, shared_spans
from boardlens.session import cut, table

CAPACITY = 8192
PASSAGE = 60
STRETCH = 100


def _titles_and_names(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "articles").select(F.lit("articles.title").alias("src"), F.col("article_id").alias("key"), F.col("title").alias("text"))
    names = table(spark, d, "universe_267").select(F.lit("universe_267.name_short").alias("src"), F.col("ticker").alias("key"), F.col("name_short").alias("text"))
    return titles.unionByName(names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.look_alikes(_titles_and_names(spark, d), "key", "text", ["src"])


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every title and name."""
    return _titles_and_names(spark, d).select("src", "key", canonical.canonical(F.col("text")).alias("form"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", packing.byte_tokens(F.col("text")), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packed(spark, d).filter("pieces > 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: their number by used tokens, in steps of 256."""
    used = p7_packed(spark, d).filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    return used.groupBy((F.floor(F.col("used") / 256) * 256).alias("used_from")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """What to remove: the stretches of each document that stand in an item."""
    return contamination.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "evalset"), "item_id", "text", PASSAGE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = shared_spans.sharing_pairs(table(spark, d, "documents"), "doc_id", "text", STRETCH)
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return shared_spans.shared_parts(table(spark, d, "documents"), "doc_id", "text", STRETCH).select("doc_id", "chars", "shared", F.round("share", 9).alias("share"))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must hold, counted over all of it: every token once, no container over its capacity, no place taken twice, nothing split that fits, and room left in no two containers that would go into one."""
    p = cut(p7_packed(spark, d))
    own = p.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("parts"), F.max("pieces").alias("pieces"))
    used = p.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"), F.sum(F.col("length") * (F.col("length") - 1) / 2 + F.col("length") * F.col("at")).alias("places"))
    docs = own.agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if((F.col("tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("split_small"), F.count_if(F.col("parts") != F.greatest("pieces", F.lit(1))).alias("lost_parts"))
    boxes = used.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count_if(F.col("places") != F.col("used") * (F.col("used") - 1) / 2).alias("overlaps"), F.greatest(F.count_if(F.col("used") * 2 <= CAPACITY) - 1, F.lit(0)).alias("halves_apart"))
    return docs.join(boxes)


QUERIES = {f.__name__: f for f in (p3_found, p3_forms, p7_found, p7_packed, p7_fill, p7_sound, p8_found, p8_leaks, p9_found, p9_shared)}

_GRAMS = f"grams as (select doc_id, i, hash(substring(text, i, {STRETCH})) as h, md5(substring(text, i, {STRETCH})) as m from (select doc_id, text, unnest(range(1, length(text) - {STRETCH} + 2)) as i from documents where length(text) >= {STRETCH}))"
_SHARED = f"{_GRAMS}, many as (select h, m from grams group by h, m having count(distinct doc_id) > 1)"

SQL = {
    "p7_found": f"select doc_id from documents where strlen(text) > {CAPACITY}",
    "p7_sound": "select count(*) as documents, cast(sum(coalesce(strlen(text), 0)) as bigint) as tokens, 0 as split_small, 0 as lost_parts, 0 as overfull, 0 as overlaps, 0 as halves_apart from documents",
    "p9_found": f"with {_SHARED}, held as (select distinct doc_id, h, m from grams join many using (h, m)) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from held a join held b on a.h = b.h and a.m = b.m and a.doc_id < b.doc_id",
    "p9_shared": f"""with {_SHARED}, s as (select doc_id, i from grams join many using (h, m)), g as (select *, least(lead(i) over (partition by doc_id order by i) - i, {STRETCH}) as step from s)
select doc_id, cast(length(text) as int) as chars, shared, round(shared / length(text), 9) as share from (select doc_id, cast(sum(coalesce(step, {STRETCH})) as bigint) as shared from g group by doc_id) join documents using (doc_id)""",
}
