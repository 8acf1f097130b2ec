import random

import numpy as np
import pytest

from boardlens.llm import contamination as k
from boardlens.llm.fm_index import FMIndex, suffix_array


@pytest.mark.parametrize(("n", "symbols"), [(1, 1), (2, 1), (50, 1), (300, 3), (2000, 50), (500, 500)])
def test_fm_index(n, symbols):
    r = np.random.default_rng(n)
    s = r.integers(0, symbols, n)
    if n == 300:
        s[100:200] = s[:100]
    t = s.tolist()
    assert suffix_array(np.concatenate((s + 1, [0]))).tolist() == sorted(range(n + 1), key=lambda i: (t + [-1])[i:])
    index = FMIndex(s, symbols, 4)
    for m in (1, 2, 3, 7):
        if m <= n:
            patterns = np.concatenate((np.stack([s[i : i + m] for i in r.integers(0, n - m + 1, 20)]), r.integers(0, symbols, (20, m))))
            lo, hi = index.search(patterns, np.full(40, m))
            for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - m + 1) if t[i : i + m] == p]


def brute(docs, items, least):
    parts = {i: "".join(map(chr, k.points(t))) for i, t in items if t}
    out = set()
    for d, t in docs:
        p = "".join(map(chr, k.points(t or "")))
        for i, q in parts.items():
            if any(q[a : a + least] in p for a in range(len(q) - least + 1)):
                out.add((d, i))
    return out


def _texts(seed):
    r = random.Random(seed)
    alphabet = "ab1" if seed % 2 else "三竹庭院讀者 aBcé,.。１"
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    items = [(i, word(r.choice([10, 70, 200, 300]))) for i in range(12)] + [(50, ""), (51, None), (52, "a" * 90)]
    docs = []
    for d in range(120):
        i = items[r.randrange(12)][1]
        n = r.choice([55, 59, 60, 61, 80, 150])
        at = r.randrange(max(1, len(i) - n))
        docs.append((d, word(r.randint(0, 100)) + i[at : at + n].upper() + word(r.randint(0, 100))))
    docs += [(200, ""), (201, None), (202, "a" * 200), (203, items[3][1] * 3), (204, "ａ" * 75)]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed, monkeypatch):
    docs, items = _texts(seed)
    df = spark.createDataFrame(docs, "id bigint, body string")
    ev = spark.createDataFrame(items, "item bigint, body string")
    if seed == 3:
        monkeypatch.setattr(k, "ITEMS", 500)
    got = k.leaks(df, "id", "body", ev, "item", "body", 60).collect()
    assert {(x.id, x.item) for x in got} == brute(docs, items, 60)
    texts = dict(docs)
    for x in got:
        inside = texts[x.id][x.start : x.end]
        assert brute([(0, inside)], [i for i in items if i[0] == x.item], 60), (x, inside)


def test_shards_and_long_text(monkeypatch):
    docs, items = _texts(1)
    monkeypatch.setattr(k, "SHARD", 500)
    long = [(900, "".join(t or "" for _, t in docs))]
    wanted = k.Items([(i, t) for i, t in items if t], 60)
    batch = k._leaks_in([900], [long[0][1]], wanted, "d", "i")
    assert {tuple(r.values())[:2] for r in batch.to_pylist()} == brute(long, items, 60)
    whole = k.spans_in_shard(k.points(long[0][1]), np.array([0, len(k.points(long[0][1]))]), wanted)
    monkeypatch.setattr(k, "SHARD", 4_000_000)
    assert sorted(map(tuple, batch.to_pylist()), key=str) == sorted(map(tuple, k._leaks_in([900], [long[0][1]], wanted, "d", "i").to_pylist()), key=str)
    assert len(whole)


def test_places():
    begin, until = k.places("Ａé，b")
    assert list(zip(begin, until, strict=True)) == [(0, 1), (1, 3), (4, 5)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, body string")
    assert k.leaks(df, "id", "body", spark.createDataFrame([(1, "a" * 99)], "item bigint, body string"), "item", "body").count() == 0
    assert k.leaks(spark.createDataFrame([(1, "a" * 99)], "id bigint, body string"), "id", "body", df.withColumnRenamed("id", "item"), "item", "body").count() == 0
