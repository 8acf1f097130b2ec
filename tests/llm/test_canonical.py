import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlens.llm import canonical as c

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("Ｍüvo", "Müvo"),
        ("Müvo", "Müvo"),
        ("Мüvo", "Müvo"),
        ("岑煦ロ", "岑煦口"),
        ("ﾛ", "口"),
        ("⼝", "口"),
        ("金", "金"),
        ("a​b﻿", "ab"),
        ("　a b ", "a b"),
        ("​", ""),
        ("", ""),
        ("x²①", "x²①"),
        ("Aa1", "Aa1"),
        ("é", "é"),
        ("е́", "é"),
    ],
)
def test_forms(text, form):
    assert c.canonical_text(text) == form


def test_segments_equal_whole_normalisation_and_are_stable():
    first, letters, _ = c._tables()
    pool = [chr(n) for r in ((0x20, 0x250), (0x300, 0x500), (0x1100, 0x1200), (0xAC00, 0xAC40), (0x2000, 0x2070), (0x2E80, 0x3100), (0xF900, 0xFA70), (0xFE00, 0xFFE8)) for n in range(*r)]
    r = random.Random(1)
    for _ in range(3000):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.translate(first)).translate(letters)).strip(" ")
        assert c.canonical_text(s) == whole
        assert c.canonical_text(whole) == whole


def test_pairs_against_brute_force(spark):
    r = random.Random(2)
    forms = ["Müvo 口", "Müvo 口", "Мüvo ロ", "Muvo 口", "ａｂ", "ab", " ab", "a b", "", "​", None]
    rows = [(f"k{i:03}", r.choice(forms)) for i in range(200)]
    want = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and x != y and c.canonical_text(x) == c.canonical_text(y)}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("__text", F.lit(1)).withColumn("key_a", F.lit("clash"))
    got = c.look_alikes(df, "key", "text").collect()
    assert {(x.key_a, x.key_b) for x in got} == want
    assert len(got) == len(want)


def test_by_nulls_repeats_and_empty(spark):
    rows = [("1", "ａ"), ("1", "ａ"), ("2", "a"), (None, "a"), ("3", None), ("4", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("src", F.when(F.col("key") == "4", F.lit("other")))
    got = {tuple(x) for x in c.look_alikes(df, "key", "text", ["src"]).collect()}
    assert got == {(None, "1", "2")}
    assert c.look_alikes(df.limit(0), "key", "text", ["src"]).count() == 0


def test_long_text(spark):
    text = "Мüvo口" * 50_000
    got = spark.createDataFrame([("1", text)], SCHEMA).select(c.canonical(F.col("text")).alias("f")).first().f
    assert got == "Müvo口" * 50_000
