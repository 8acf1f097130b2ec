import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boardlens.llm import packing


def best_fit(lengths, capacity):
    """One item at a time, longest first, into the container with the least room that is enough."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 37, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 400))] + [r.randint(1, capacity)] * r.randint(0, 300)
    slots, made = packing.plan(dict(Counter(lengths)), capacity)
    used = defaultdict(list)
    ranks = defaultdict(set)
    for n, first, until, container, each, at in slots:
        for k in range(until - first):
            assert first + k not in ranks[n]
            ranks[n].add(first + k)
            used[container + k // each].append((at + k % each * n, n))
    assert {n: len(x) for n, x in ranks.items()} == dict(Counter(lengths))
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    assert len(used) == made
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == sorted(best_fit(lengths, capacity))


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    monkeypatch.setattr(packing, "CELL", 7)
    rows = [(i, "x" * n) for i, n in enumerate([5, 5, 5] * 40 + [1, 2, 3, 9, 10, 11, 25, 30, 0])] + [(1000, None), (1001, "é€")]
    df = spark.createDataFrame(rows, "doc bigint, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(df, "doc", packing.byte_tokens(F.col("text")), 10).collect()
    size = {i: len((t or "").encode()) for i, t in rows}
    fill, by = defaultdict(list), defaultdict(list)
    for x in got:
        by[x.doc].append(x)
        if x.container is not None:
            fill[x.container].append((x["at"], x.length))
    assert set(by) == set(size)
    for doc, pieces in by.items():
        assert sum(p.length for p in pieces) == size[doc]
        want = -(-size[doc] // 10)
        assert all(p.pieces == want for p in pieces) and len(pieces) == max(1, want)
        assert sorted(p.start for p in pieces) == [10 * i for i in range(max(1, want))]
    for places in fill.values():
        end = 0
        for at, n in sorted(places):
            assert at >= end
            end = at + n
        assert end <= 10
    assert len(fill) <= 1 + sum(size.values()) / 9.5


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string")
    assert packing.pack(df, "doc", packing.byte_tokens(F.col("text")), 10).count() == 0
