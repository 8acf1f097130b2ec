import random
from collections import defaultdict

import pytest

from boardlens.llm import shared_spans as s


def brute_pairs(docs, least):
    at = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            at[t[i : i + least]].add(d)
    return {(a, b) for g in at.values() for a in g for b in g if a < b}


def brute_shared(docs, least):
    at = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            at[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        n = {k for i in range(len(t or "") - least + 1) if len(at[t[i : i + least]]) > 1 for k in range(i, i + least)}
        if n:
            out[d] = (len(t), len(n))
    return out


def texts(seed, least):
    r = random.Random(seed)
    alphabet = "ab" if seed == 1 else "三竹庭院讀者 aBcé\U00020000"
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [word(r.choice([least - 1, least, least + 1, 2 * least, 5 * least])) for _ in range(8)] + ["x" * (2 * least)]
    docs = []
    for d in range(70):
        docs.append((d * 7 - 50, word(r.randint(0, least)) + "".join(r.choice(passages) + word(r.randint(0, 30)) for _ in range(r.randint(0, 2)))))
    return [*docs, (900, ""), (901, None), (902, "y" * 10 * least), (903, passages[4]), (904, passages[4])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [2, 200])
def test_pairs(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(s, "HOT", hot)
    docs = texts(seed, 30)
    df = spark.createDataFrame(docs, "id bigint, body string").repartition(3)
    got = s.sharing_pairs(df, "id", "body", 30, buckets=3).collect()
    assert {tuple(x) for x in got} == brute_pairs(docs, 30)
    assert len(got) == len({tuple(x) for x in got})


def test_shared_parts(spark):
    docs = texts(2, 30)
    df = spark.createDataFrame(docs, "id bigint, body string")
    got = {x.id: (x.chars, x.shared) for x in s.shared_parts(df, "id", "body", 30, buckets=3).collect()}
    assert got == brute_shared(docs, 30)


def test_batches_and_compaction_agree(spark):
    docs = texts(0, 30)
    df = spark.createDataFrame(docs, "id bigint, body string")
    for batches in (1, 4):
        assert {tuple(x) for x in s.sharing_pairs(df, "id", "body", 30, batches=batches, buckets=2).collect()} == brute_pairs(docs, 30)


def test_increments(spark):
    docs = texts(0, 30)
    df = spark.createDataFrame(docs, "id bigint, body string")
    index = s.Index(spark, s.Windows(30), 2, fanout=1)
    found = [index.add(df.filter(f"pmod(id, 3) = {i}"), "id", "body") for i in range(3)]
    assert len(index.runs) == 1
    pairs = found[0].unionByName(found[1]).unionByName(found[2])
    got = {(x.doc_a, x.doc_b) for x in s.verified(pairs, df, "id", "body", index.windows).collect()}
    index.close()
    assert got == brute_pairs(docs, 30)


@pytest.mark.parametrize("hot", [2, 200])
def test_shared_parts_of_hot_texts(spark, hot, monkeypatch):
    monkeypatch.setattr(s, "HOT", hot)
    docs = texts(0, 30)[:40]
    df = spark.createDataFrame(docs, "id bigint, body string")
    assert {x.id: (x.chars, x.shared) for x in s.shared_parts(df, "id", "body", 30, buckets=2).collect()} == brute_shared(docs, 30)


def test_boilerplate_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT", 20)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    footer = word(29)
    docs = [(i, word(40) + footer + word(40)) for i in range(60)] + [(100 + i, word(5) + "z" * 20_000) for i in range(3)] + [(200, "z" * 29), (201, word(9) + docs_tail(footer) + word(9)), (202, docs_tail(footer))]
    df = spark.createDataFrame(docs, "id bigint, body string")
    got = {tuple(x) for x in s.sharing_pairs(df, "id", "body", 30, buckets=2).collect()}
    assert got == brute_pairs(docs, 30) >= {(100, 101), (100, 102), (101, 102), (201, 202)}


def docs_tail(footer):
    return footer + "!"


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, body string")
    assert s.sharing_pairs(df, "id", "body", 30, buckets=2).count() == 0
