"""Evaluation texts leaking into training text: which documents hold passages of which items, and where.

Each training shard gets an FM-index. Its symbols aren't characters but the short phrases between
minimizers, positions that content alone determines: a passage of `least` characters that stands
in both texts is cut alike in both but for its ends, so that the phrases in between are found by
backward search, some five times fewer symbols than characters. What is located is then extended
and checked character by character.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardlens.llm.fm_index import FMIndex
from boardlens.llm.hashing import Hashes, code_points, minimizers
from boardlens.session import cut as written

#: Characters of the grams that order positions, and grams per window.
GRAM, WINDOW = 4, 8
#: Normalised characters of a shard, and of the items that one pass over the corpus looks for.
SHARD, ITEMS = 4_000_000, 2_000_000
_KEPT: list[np.ndarray] = []


def _kept() -> np.ndarray:
    if not _KEPT:
        _KEPT.append(np.frombuffer(bytes(unicodedata.category(chr(n))[0] in "LN" for n in range(0x110000)), dtype=bool))
    return _KEPT[0]


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


def points(text: str) -> np.ndarray:
    """The letters and numbers of text in NFKC form and lower case, as code points."""
    p = code_points(folded(text))
    return p[_kept()[p]]


class Items:
    """The patterns of a block of items: for each stretch of `least` characters the whole phrases it is sure to share with any text that holds it."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.text = [points(t) for _, t in items]
        item, at, phrases = [], [], []
        for i, p in enumerate(self.text):
            if len(p) < least:
                continue
            h = Hashes(p)
            cuts = minimizers(h.grams(GRAM), WINDOW)
            names = h.of(cuts[:-1], cuts[1:])
            begin = np.arange(len(p) - least + 1)
            lo = np.searchsorted(cuts, begin + WINDOW - 1)
            hi = np.searchsorted(cuts, begin + least - GRAM - WINDOW + 1, side="right") - 1
            pairs = np.unique(np.stack((lo, hi), 1), axis=0)
            for k, (a, b) in enumerate(pairs):
                if k + 1 < len(pairs) and pairs[k + 1][1] == b or k and pairs[k - 1][0] == a:
                    continue  # it holds the pattern next to it, which is searched anyway
                item.append(i)
                at.append(cuts[a])
                phrases.append(names[a:b])
        self.item, self.at = np.array(item, dtype=np.int64), np.array(at, dtype=np.int64)
        self.lengths = np.array([len(x) for x in phrases], dtype=np.int64)
        self.phrases = np.zeros((len(phrases), int(self.lengths.max(initial=1))), dtype=np.uint64)
        for k, x in enumerate(phrases):
            self.phrases[k, : len(x)] = x
        self.flat = np.concatenate(self.text) if self.text else np.zeros(0, dtype=np.uint32)
        self.offset = np.concatenate(([0], np.cumsum([len(p) for p in self.text]))).astype(np.int64)


def spans_in_shard(text: np.ndarray, offset: np.ndarray, items: Items) -> np.ndarray:
    """Rows (document, item, start, end), indices and places in a document of text, document d being text[offset[d]:offset[d + 1]]; merged, each at least items.least long."""
    none = np.zeros((0, 4), dtype=np.int64)
    h = Hashes(text)
    cuts = minimizers(h.grams(GRAM), WINDOW)
    if len(cuts) < 2 or not len(items.item):
        return none
    names, s = np.unique(h.of(cuts[:-1], cuts[1:]), return_inverse=True)
    del h
    place = np.searchsorted(names, items.phrases)
    known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == items.phrases)
    known |= np.arange(items.phrases.shape[1])[None, :] >= items.lengths[:, None]
    able = np.flatnonzero(known.all(1))
    if not len(able):
        return none
    index = FMIndex(s, len(names))
    lo, hi = index.search(place[able], items.lengths[able])
    out = []
    width = hi - lo
    for part in np.array_split(np.arange(len(able)), max(1, int(width.sum()) // 200_000)):
        rows = np.repeat(lo[part], width[part]) + np.arange(width[part].sum()) - np.repeat(np.cumsum(width[part]) - width[part], width[part])
        if len(rows):
            which = np.repeat(able[part], width[part])
            out.append(_extended(text, offset, items, cuts[index.locate(rows)], items.item[which], items.at[which]))
    return _merged(np.concatenate(out)) if out else none


def _extended(text: np.ndarray, offset: np.ndarray, items: Items, at: np.ndarray, item: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The stretches around text[at] and item[q] in which both agree, up to twice `least` either way, as far as they are long enough."""
    doc = np.searchsorted(offset, at, side="right") - 1
    same = np.unique(np.stack((doc, item, at - q, at // (items.least // 2)), 1), axis=0, return_index=True)[1]
    doc, item, at, q = doc[same], item[same], at[same], q[same]
    found = []
    far = 2 * items.least
    reach = np.arange(-far, far)
    for i in range(0, len(at), 20_000):
        d, it, a, b = (x[i : i + 20_000, None] for x in (doc, item, at, q))
        t, u = a + reach, b + items.offset[it] + reach
        ok = (t >= offset[d]) & (t < offset[d + 1]) & (u >= items.offset[it]) & (u < items.offset[it + 1])
        ok &= text[np.clip(t, 0, len(text) - 1)] == items.flat[np.clip(u, 0, len(items.flat) - 1)]
        right = np.where(ok[:, far:].all(1), far, np.argmin(ok[:, far:], 1))
        left = np.where(ok[:, :far].all(1), far, np.argmin(ok[:, :far][:, ::-1], 1))
        good = left + right >= items.least
        begin = a[:, 0] - offset[d[:, 0]]
        found.append(np.stack((d[:, 0], it[:, 0], begin - left, begin + right), 1)[good])
    return np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of a document and item as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    out = [rows[0].copy()]
    for r in rows[1:]:
        if (r[:2] == out[-1][:2]).all() and r[2] <= out[-1][3]:
            out[-1][3] = max(out[-1][3], r[3])
        else:
            out.append(r.copy())
    return np.array(out)


_CLUSTER = regex.compile(r"(?s).[\p{M}\uff9e\uff9f\u1160-\u11ff]*")


@functools.lru_cache(maxsize=200_000)
def _size(cluster: str) -> int:
    return len(points(cluster))


def places(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(begin, until): for each letter or number of text's normalised form, where in text the cluster of a character and its marks stands that it comes from.

    None where the clusters' forms don't add up to the whole's (scripts that compose in other ways).
    """
    clusters = _CLUSTER.findall(text)
    sizes = np.array([_size(c) if len(c) < 50 else len(points(c)) for c in clusters], dtype=np.int64)
    if sizes.sum() != len(points(text)):
        return None
    ends = np.cumsum([len(c) for c in clusters])
    return np.repeat(ends - [len(c) for c in clusters], sizes), np.repeat(ends, sizes)


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 60) -> DataFrame:
    """(key, item_key, start, end): the stretches of each document's text, as written, that stand in an item too: what to remove.

    Both texts are compared in NFKC form, in lower case and by letters and numbers only; a stretch
    is at least `least` such characters. Overlapping stretches of a document and item are merged.
    Null and empty texts hold nothing, items of fewer characters leak nowhere, rows that repeat a
    key are documents of their own. Key columns are bigint.

    The corpus is only scanned: no shuffle, no key that could be hot. A task cuts its rows into
    shards of bounded size, a text longer than that into overlapping parts, and indexes one at a
    time. Items are sent to the tasks in blocks of ITEMS characters and one item at most, in the
    order of their keys; more items mean more passes. An item is a test item: one longer than
    ITEMS makes its block as long as itself.
    """
    size = F.char_length("__t").cast("bigint")
    before = F.coalesce(F.sum(size).over(Window.orderBy("__k", "__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = items.select(F.col(f"`{item_key}`").cast("bigint").alias("__k"), F.col(f"`{item_text}`").alias("__t")).filter("__k is not null and __t is not null")
    own = written(own.withColumn("__block", F.floor(before / F.lit(ITEMS)).cast("int")))
    blocks = [r[0] for r in own.select("__block").distinct().orderBy("__block").collect()] or [0]
    spark, out = docs.sparkSession, None
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).filter("k is not null and t is not null and t != ''")
    schema = f"`{key}` bigint, `{item_key}` bigint, start int, end int"
    for block in blocks:
        mine = own.filter(F.col("__block") == block).select("__k", "__t")
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])  # about ITEMS characters

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = Items(sent.value, least)
            for ids, texts in _shards(batches):
                yield _leaks_in(ids, texts, wanted, key, item_key)

        part = src.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            if size and size + len(t) > SHARD:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(k)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def _leaks_in(ids: list[int], texts: list[str], wanted: Items, key: str, item_key: str) -> pa.RecordBatch:
    parts = [code_points(folded(t)) for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    whole = np.concatenate(parts)
    keep = _kept()[whole]
    offset = np.concatenate(([0], np.cumsum(keep)))[ends]
    whole = whole[keep]
    del parts, keep
    rows = []
    for first in range(0, max(1, len(whole)), SHARD):  # one part, unless a text alone is longer
        until = min(len(whole), first + SHARD + 4 * wanted.least)
        cut = np.clip(offset, first, until) - first
        found = spans_in_shard(whole[first:until], cut, wanted)
        found[:, 2:] += (np.maximum(offset[:-1], first) - offset[:-1])[found[:, 0]][:, None]
        rows.append(found)
    merged = _merged(np.concatenate(rows))
    out, at = [], (-1, None)
    for d, i, a, b in merged.tolist():
        if at[0] != d:
            at = (d, places(texts[d]))
        begin, until = at[1] or (None, None)
        out.append((ids[d], int(wanted.ids[i]), 0 if begin is None else int(begin[a]), len(texts[d]) if until is None else int(until[b - 1])))
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=[key, item_key, "start", "end"])
