"""Names and codes found in texts, without comparing every name with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def name_hits(texts: DataFrame, key: str, text: str, names: DataFrame, code: str, name: str, gram: int = 2) -> DataFrame:
    """(key, code): the texts in which a name stands.

    A text asks for its grams, a name answers to its first one; what meets is checked as a whole.
    So rows meet by equality; names shorter than gram meet texts by their first character.
    """
    t = texts.select(F.col(key), F.col(text).alias("__t")).filter("__t is not null")
    n = names.select(F.col(code), F.col(name).alias("__n")).filter("__n is not null and __n != ''").distinct()
    def met(size: int, some: DataFrame) -> DataFrame:
        asked = t.select(key, "__t", F.explode(grams(F.col("__t"), size)).alias("__g"))
        return asked.join(some.withColumn("__g", F.substring("__n", 1, size)), "__g").filter(F.col("__t").contains(F.col("__n"))).select(key, code)

    short = F.char_length("__n") < gram
    return met(gram, n.filter(~short)).unionByName(met(1, n.filter(short))).distinct()


def code_hits(texts: DataFrame, key: str, text: str, codes: DataFrame, code: str) -> DataFrame:
    """(key, code): the texts in which a code stands as a number of its own."""
    t = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([0-9]+)"), F.lit(1)))).alias(code))
    return t.join(codes.select(code).distinct(), code).select(key, code).distinct()


def rule_hits(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, code): the texts that a rule finds by its code or its name.

    rules: (code, name, by_name, by_code, exclude), exclude being the words, longer names and the
    like, that are taken out, one after the other, before the name is looked for. Names with Latin
    letters are found whatever the case. Candidates meet by equality (name_hits, code_hits); only
    those are looked at with their words taken out.
    """
    t = texts.select(F.col(key).alias("__key"), F.translate(F.coalesce(F.col(text), F.lit("")), "臺", "台").alias("__t"))
    t = t.withColumn("__low", F.lower("__t"))
    latin = F.col("name").rlike("[A-Za-z]")
    named = rules.filter("by_name and name != ''").withColumns({"__latin": latin, "__n": F.when(latin, F.lower("name")).otherwise(F.col("name"))})
    met = name_hits(t, "__key", "__t", named.filter("not __latin"), "code", "__n").unionByName(name_hits(t, "__key", "__low", named.filter("__latin"), "code", "__n"))
    near = met.join(named.select("code", "__n", "__latin", "exclude"), "code").join(t, "__key")
    words = F.filter(F.split(F.coalesce("exclude", F.lit("")), "/"), lambda x: x != "")
    rest = F.aggregate(words, F.col("__t"), lambda left, x: F.replace(left, x, F.lit("")))
    stands = F.when(F.col("__latin"), F.lower(rest)).otherwise(rest).contains(F.col("__n"))
    by_code = code_hits(t, "__key", "__t", rules.filter("by_code"), "code")
    return near.filter(stands).select("__key", "code").unionByName(by_code).distinct().select(F.col("__key").alias(key), "code")


def thread_items(articles: DataFrame, comments: DataFrame, hits: DataFrame, said: DataFrame | None = None, max_lag_days: int = 30) -> DataFrame:
    """(code, time): articles that name a code, and comments in their threads, or that name it themselves (said: (article_id, idx, code)); comments later than max_lag_days after their article don't count."""
    own = articles.join(hits, "article_id").select("code", "time")
    near = comments.filter(F.coalesce(F.col("lag_sec") <= max_lag_days * 86400, F.lit(False)))
    below = near.join(hits, "article_id").select("article_id", "idx", "code", "time")
    if said is not None:
        below = below.unionByName(near.join(said, ["article_id", "idx"]).select("article_id", "idx", "code", "time")).distinct()
    return own.unionByName(below.select("code", "time"))


def name_flags(stats: DataFrame, least_hits: int = 5, least_frac: float = 0.8, board_hits: int = 10, years: tuple[int, int] = (1990, 2030)) -> DataFrame:
    """stats (code, name, hits, tag_frac, board_hits) with why a name or code is to be checked by hand: low_tag, most hits aren't tagged; no_news, a short name that news don't tell of; code_year, a code that looks like a year."""
    known = F.col("hits") >= least_hits
    return stats.withColumns(
        {
            "low_tag": F.coalesce(known & (F.col("tag_frac") < least_frac), F.lit(False)),
            "no_news": F.coalesce(~known & (F.col("board_hits") >= board_hits) & (F.char_length("name") <= 2), F.lit(False)),
            "code_year": F.coalesce(F.col("code").try_cast("int").between(*years), F.lit(False)),
        }
    )


def match_rules(flags: DataFrame, precision: DataFrame, least: float = 0.8) -> DataFrame:
    """flags with by_name and by_code, whether checks (code, kind, precision) let the board's texts be found so (unchecked ones do), and by_title, whether news titles may."""
    p = precision.groupBy("code").agg(F.max(F.when(F.col("kind") == "name", F.col("precision"))).alias("name_precision"), F.max(F.when(F.col("kind") == "code", F.col("precision"))).alias("code_precision"))
    d = flags.join(p, "code", "left")
    fine = lambda c: F.coalesce(F.col(c) >= least, F.lit(True))
    return d.withColumns({"by_name": fine("name_precision"), "by_code": fine("code_precision")}).withColumn("by_title", ~F.col("low_tag") & F.col("by_name"))


def superstrings(names: DataFrame, code: str, name: str) -> DataFrame:
    """(code, name, longer): for each name the sorted other names that hold it, joined by /."""
    n = names.select(F.col(code), F.col(name).alias("__n")).filter("__n is not null").distinct()
    hits = name_hits(n.withColumn("__key", F.col("__n")), "__key", "__n", n, code, "__n")
    longer = hits.join(n, code).filter("__key != __n").groupBy(code, F.col("__n").alias(name)).agg(F.array_join(F.array_sort(F.collect_set("__key")), "/").alias("longer"))
    return longer
