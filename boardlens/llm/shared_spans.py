"""Long exact spans shared between records, by a log-structured index of fingerprints.

Of each text the index keeps hashes of some windows, chosen by content so that every stretch of
`least` characters that two texts share holds a window chosen in both (winnowing). The hashes of a
batch become an immutable run, sorted and bucketed by hash; a new batch is merge-joined with
itself and with the runs before it, bucket by bucket without a shuffle, and runs are compacted
into larger ones as they grow in number.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm.hashing import LONGEST, Hashes, code_points, window_minima
from boardlens.session import cut, drop_table, shared_dir

#: Code points hashed at a time.
CHUNK = 4_000_000
#: Windows of one hash in a run beyond which its rows are told apart by longer windows before they are paired.
HOT = 200
FINGERPRINT = "hash bigint, link bigint, doc bigint, pos int"
SURROUNDINGS = ", around bigint, lead int, tail int"


@dataclass(frozen=True)
class Windows:
    """least = gram + window - 1: each `window` successive grams hold a fingerprint."""

    least: int = 100

    @property
    def gram(self) -> int:
        return self.least // 2 + 1

    @property
    def window(self) -> int:
        return self.least - self.gram + 1

    @property
    def side(self) -> int:
        """A stretch of `least` around a gram reaches that far beyond it."""
        return self.least - self.gram


def fingerprints(docs: DataFrame, key: str, text: str, w: Windows, surroundings: bool = False) -> DataFrame:
    """(hash, link, doc, pos): the chosen windows of each text.

    link is the hash of the stretch from the window chosen before to the end of this one, 0 for a
    text's first: two texts that agree in hash and link agreed in the window before as well.
    With surroundings there are also lead and tail, how many characters a stretch of `least` that
    holds the window can reach before and after it, and around, the hash of all of that.
    """
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.col("k").isNotNull() & (F.char_length("t") >= w.least))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, offset, points in _chunks(batches):
            yield _chosen(ids, offset, points, w, surroundings)

    return src.mapInArrow(choose, FINGERPRINT + (SURROUNDINGS if surroundings else ""))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, offsets and code points of texts, some CHUNK code points at a time; a longer text is one chunk."""
    for b in batches:
        ids, texts = b.column(0).to_numpy(), b.column(1)
        first, size = 0, 0
        parts: list[np.ndarray] = []
        for i in range(len(texts) + 1):
            p = code_points(texts[i].as_py()) if i < len(texts) else None
            if parts and (p is None or size + len(p) > CHUNK):
                yield ids[first:i], np.concatenate(([0], np.cumsum([len(x) for x in parts]))), np.concatenate(parts)
                parts, first, size = [], i, 0
            if p is not None:
                parts.append(p)
                size += len(p)


def _chosen(ids: np.ndarray, offset: np.ndarray, points: np.ndarray, w: Windows, surroundings: bool) -> pa.RecordBatch:
    h = Hashes(points)
    grams = h.grams(w.gram)
    pos = np.concatenate([*_local_minima(grams, offset, w)]) if len(grams) else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(offset, pos, side="right") - 1
    before = np.concatenate(([0], pos[:-1]))
    follows = np.concatenate(([False], doc[1:] == doc[:-1])) if len(doc) else np.zeros(0, dtype=bool)
    link = np.where(follows, h.of(before, pos + w.gram), np.uint64(0)).astype(np.uint64)
    cols = {"hash": grams[pos].view(np.int64), "link": link.view(np.int64), "doc": ids[doc].astype(np.int64), "pos": (pos - offset[doc]).astype(np.int32)}
    if surroundings:
        first, last = np.maximum(pos - w.side, offset[doc]), np.minimum(pos + w.least, offset[doc + 1])
        cols |= {"around": h.of(first, last).view(np.int64), "lead": (pos - first).astype(np.int32), "tail": (last - pos - w.gram).astype(np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _local_minima(grams: np.ndarray, offset: np.ndarray, w: Windows) -> Iterator[np.ndarray]:
    """Positions chosen by windows that lie in one text."""
    step = LONGEST - w.window
    for first in range(0, len(grams), step):  # one part, unless a text alone is longer
        m = window_minima(grams[first : first + step + w.window - 1], w.window) + first
        if not len(m):
            continue
        start = np.arange(first, first + len(m))
        doc = np.searchsorted(offset, start, side="right") - 1
        m = m[start + w.least <= offset[doc + 1]]
        if len(m):
            yield m[np.concatenate(([True], m[1:] != m[:-1]))]
    yield np.zeros(0, dtype=np.int64)


@dataclass
class Index:
    """The runs of fingerprints, oldest first, as tables in the shared folder, bucketed and sorted by hash."""

    spark: SparkSession
    windows: Windows = field(default_factory=Windows)
    buckets: int = 12
    fanout: int = 3
    surroundings: bool = False
    runs: list[str] = field(default_factory=list)
    hot: list[str] = field(default_factory=list)
    met: list[str] = field(default_factory=list)

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}"
        rows.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def _run(self, docs: DataFrame, key: str, text: str) -> tuple[str, DataFrame]:
        name = f"fingerprints_{uuid.uuid4().hex}"
        return name, self._write(fingerprints(docs, key, text, self.windows, self.surroundings), name)

    def _append(self, name: str) -> None:
        self.runs.append(name)
        if len(self.runs) > self.fanout:
            self.compact()

    def add(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """The batch docs as a new run; the pairs of windows (doc_a, pos_a, doc_b, pos_b), doc_a < doc_b, that it shares with itself and the runs before.

        Of windows that follow each other in both texts only the first is a pair. Hashes that all
        runs together hold more than HOT times are left to hot_doc_pairs.
        """
        name, new = self._run(docs, key, text)
        many = f"{name}_hot"
        count = new.groupBy("hash").count()
        for i, old in enumerate(self.runs):
            count = count.join(self.spark.table(old).groupBy("hash").agg(F.count("*").alias(f"n{i}")).hint("merge"), "hash", "left")
        total = sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(self.runs))), F.col("count"))
        self._write(count.filter(total > HOT).select("hash"), many)
        self.hot.append(many)
        new = self._cold(new)
        pairs = _pairs(new, new).filter("doc_a < doc_b")
        for old in self.runs:
            met = _pairs(new, self._cold(self.spark.table(old))).filter("doc_a != doc_b")
            turn = F.col("doc_a") < F.col("doc_b")
            swap = [F.when(turn, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("doc", "pos")]
            pairs = pairs.unionByName(met.select(*swap))
        pairs = cut(pairs)
        self._append(name)
        return pairs

    def meet(self, docs: DataFrame, key: str, text: str) -> None:
        """The batch docs as a new run, with note taken of the hashes that stand in two documents since, of the batch or of the runs before: no pair is formed."""
        name, new = self._run(docs, key, text)
        ends = lambda run, a, b: run.groupBy("hash").agg(F.min("doc").alias(a), F.max("doc").alias(b))
        mine = ends(new, "a", "b")
        met = mine.filter("a != b").select("hash")
        for old in self.runs:
            met = met.unionByName(mine.join(ends(self.spark.table(old), "c", "d").hint("merge"), "hash").filter("a != c or a != d or b != c").select("hash"))
        self._write(met.distinct(), f"{name}_met")
        self.met.append(f"{name}_met")
        self._append(name)

    def _cold(self, run: DataFrame) -> DataFrame:
        for many in self.hot:
            run = run.join(self.spark.table(many), "hash", "left_anti")
        return run

    def rows_of(self, tables: list[str]) -> DataFrame:
        """The fingerprints of all runs whose hash is in any of tables."""
        some = functools.reduce(DataFrame.unionByName, map(self.spark.table, tables)).distinct()
        return functools.reduce(DataFrame.unionByName, [self.spark.table(r).join(some, "hash", "left_semi") for r in self.runs])

    def compact(self) -> None:
        """All runs as one."""
        rows = functools.reduce(DataFrame.unionByName, map(self.spark.table, self.runs))
        name = f"fingerprints_{uuid.uuid4().hex}"
        self._write(rows, name)
        for r in self.runs:
            drop_table(self.spark, r)
        self.runs = [name]

    def close(self) -> None:
        for name in (*self.runs, *self.hot, *self.met):
            drop_table(self.spark, name)
        self.runs, self.hot, self.met = [], [], []


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("hash", *[F.col(c).alias(f"{c}_a") for c in ("link", "doc", "pos")])
    y = b.select("hash", *[F.col(c).alias(f"{c}_b") for c in ("link", "doc", "pos")])
    return x.join(y.hint("merge"), "hash").filter("link_a != link_b or link_a = 0").select("doc_a", "pos_a", "doc_b", "pos_b")


def _around(rows: DataFrame, docs: DataFrame, key: str, text: str, w: Windows) -> DataFrame:
    """rows (doc, pos, ...) with what stands around each window: around, from code point pos - side, and lead, the code points missing before it."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("__t")).filter(F.col("doc").isNotNull() & (F.char_length("__t") >= w.least))
    begin = F.col("pos") - w.side
    cut_out = F.substring("__t", F.greatest(begin, F.lit(0)) + 1, F.lit(w.least + w.side) + F.least(begin, F.lit(0)))
    return rows.join(src, "doc").select(*rows.columns, cut_out.alias("around"), F.greatest(-begin, F.lit(0)).alias("lead"))


def _window_at(j: Column, around: Column, lead: Column, w: Windows) -> Column:
    """The j-th of the windows of `least` code points that hold the gram, null where the text doesn't reach that far."""
    return F.when((j >= lead) & (j - lead + w.least <= F.char_length(around)), F.substring(around, j - lead + 1, F.lit(w.least)))


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, w: Windows) -> DataFrame:
    """The pairs of windows around which both texts agree in `least` code points, character by character."""
    pairs = pairs.distinct()
    at = pairs.select(F.col("doc_a").alias("doc"), F.col("pos_a").alias("pos")).unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("pos_b").alias("pos"))).distinct()
    near = cut(_around(at, docs, key, text, w))
    a, b = (near.select(F.col("doc").alias(f"doc_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("around").alias(f"around_{s}"), F.col("lead").alias(f"lead_{s}")) for s in "ab")
    met = pairs.join(a, ["doc_a", "pos_a"]).join(b, ["doc_b", "pos_b"])
    agrees = F.exists(F.sequence(F.lit(0), F.lit(w.side)), lambda j: F.coalesce(_window_at(j, F.col("around_a"), F.col("lead_a"), w) == _window_at(j, F.col("around_b"), F.col("lead_b"), w), F.lit(False)))
    return met.filter(agrees).select("doc_a", "pos_a", "doc_b", "pos_b")


def hot_doc_pairs(index: Index, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the documents that share a window of `least` around a hot hash.

    Windows of `least` that stand in the same documents say the same of them: of each set of
    documents one window is kept, told by two sums over its members, so that a copied text makes
    each pair once however long it is, and a run of one character once however often it holds
    itself. Each member's window is compared with that of the set's first, character by character.
    """
    w = index.windows
    near = _around(index.rows_of(index.hot).select("doc", "pos").distinct(), docs, key, text, w)
    windows = near.select("doc", "pos", "around", "lead", F.explode(F.sequence(F.lit(0), F.lit(w.side))).alias("j")).select("doc", "pos", "j", _window_at(F.col("j"), F.col("around"), F.col("lead"), w).alias("at")).filter("at is not null")
    where = F.col("pos").cast("bigint") * w.least + F.col("j")
    windows = cut(windows.groupBy("doc", F.xxhash64("at").alias("h1"), F.xxhash64(F.lit(1), "at").alias("h2")).agg(F.min(where).alias("where")))
    sets = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("s2"), F.min("doc").alias("first")).filter("n > 1")
    one = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("h1", "h2", "first")).alias("h")).select("h.*")
    members = windows.join(one, ["h1", "h2"]).select("h1", "h2", "first", "doc", F.floor(F.col("where") / w.least).cast("int").alias("pos"), (F.col("where") % w.least).alias("j"))
    said = _around(members, docs, key, text, w).select("h1", "h2", "first", "doc", _window_at(F.col("j"), F.col("around"), F.col("lead"), w).alias("at"))
    named = said.filter("doc = first").select("h1", "h2", F.col("at").alias("__at"))
    equal = cut(said.join(named, ["h1", "h2"]).filter("at = __at").select("h1", "h2", "doc"))
    a, b = (equal.select("h1", "h2", F.col("doc").alias(f"doc_{x}")) for x in "ab")
    return a.join(b, ["h1", "h2"]).filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def _index(docs: DataFrame, least: int, buckets: int | None, surroundings: bool = False) -> Index:
    spark = docs.sparkSession
    return Index(spark, Windows(least), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=2, surroundings=surroundings)


def _batches(docs: DataFrame, key: str, batches: int) -> Iterator[DataFrame]:
    part = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("bigint")), F.lit(batches))
    return (docs.filter(part == b) for b in range(batches))


def sharing_pairs(docs: DataFrame, key: str, text: str, least: int = 100, batches: int = 3, buckets: int | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the documents that share a stretch of at least `least` code points.

    The documents go through the index in batches, as they would over time: what a batch finds are
    its pairs with itself and with all before. Stretches count exactly as written; within one
    document they don't count. Null and shorter texts share nothing; key is unique and bigint
    (rows that repeat a key are taken as one document). Extra columns are left out.
    """
    with _index(docs, least, buckets) as index:
        found = functools.reduce(DataFrame.unionByName, [index.add(b, key, text) for b in _batches(docs, key, batches)])
        hot = cut(hot_doc_pairs(index, docs, key, text)) if any(not index.spark.table(h).isEmpty() for h in index.hot) else None
    pairs = verified(found, docs, key, text, index.windows).select("doc_a", "doc_b")
    return (pairs if hot is None else pairs.unionByName(hot)).distinct()


_CLASS = ["hash", "around", "lead"]


def shared_parts(docs: DataFrame, key: str, text: str, least: int = 100, batches: int = 3, buckets: int | None = None) -> DataFrame:
    """(key, chars, shared, share, spans): of each document how much of its text stands in another one too; on odd cases see sharing_pairs.

    spans are the stretches [start, end), in code points, merged where they overlap or touch; only
    documents that share anything have a row. No pairs are formed. Windows whose surroundings are
    equal form a class; where a class stands in two documents, all that surrounds its windows is
    shared, and each is set against one of another document: n copies make n links. Successive
    links of two documents are one stretch, compared by the SHA-256 of its characters, taken where
    either text is. Where a hash has several classes, one window of each is told apart by the
    stretches of `least` around it, by their SHA-256 as well.
    """
    w = Windows(least)
    with _index(docs, least, buckets, surroundings=True) as index:
        for b in _batches(docs, key, batches):
            index.meet(b, key, text)
        rows = cut(index.rows_of(index.met).drop("link").distinct())
    place = F.struct("doc", "pos", "tail")
    classes = cut(rows.groupBy(*_CLASS).agg(F.min(place).alias("first"), F.max(place).alias("last")))
    links = _stretches(rows.join(classes.filter("first.doc != last.doc"), _CLASS), w)
    links = cut(links)
    own = links.select("doc", "s", "e").unionByName(links.select(F.col("other").alias("doc"), (F.col("s") + F.col("by")).alias("s"), (F.col("e") + F.col("by")).alias("e"))).distinct()
    digests = cut(_text_of(own, docs, key, text).select("doc", "s", "e", "n", F.sha2("at", 256).alias("digest")))
    theirs = digests.select(F.col("doc").alias("other"), F.col("s").alias("__s"), F.col("digest").alias("__digest"), F.col("e").alias("__e"))
    met = links.withColumns({"__s": F.col("s") + F.col("by"), "__e": F.col("e") + F.col("by")}).join(digests, ["doc", "s", "e"]).join(theirs, ["other", "__s", "__e"])
    met = cut(met.select("doc", "s", "e", "n", (F.col("digest") == F.col("__digest")).alias("equal")))
    good = met.filter("equal").select("doc", "s", "e", "n")
    unequal = met.filter("not equal")
    if not unequal.isEmpty():  # equal hashes of different texts: their windows are looked at one by one
        doubtful = rows.join(unequal.select("doc", "s", "e"), "doc").filter("pos >= s and pos < e").select("hash").distinct()
        alone = rows.join(doubtful, "hash", "left_semi").select(*_CLASS, place.alias("first"), place.alias("last"))
        classes = classes.join(doubtful, "hash", "left_anti").unionByName(alone)
        several = classes.groupBy("hash").count().filter("count > 1").select("hash").unionByName(doubtful).distinct()
    else:
        several = classes.groupBy("hash").count().filter("count > 1").select("hash")
    spans = good.unionByName(_parts_of_classes(classes.join(several, "hash", "left_semi"), rows, docs, key, text, w)).distinct()
    marked = spans.selectExpr("*", "case when s <= max(e) over (partition by doc order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh")
    runs = marked.selectExpr("*", "sum(fresh) over (partition by doc order by s, e rows unbounded preceding) as run").groupBy("doc", "n", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    total = runs.groupBy("doc", "n").agg(F.sum(F.col("e") - F.col("s")).alias("shared"), F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("spans"))
    return total.select(F.col("doc").alias(key), F.col("n").alias("chars"), "shared", (F.col("shared") / F.col("n")).alias("share"), "spans")


def _stretches(members: DataFrame, w: Windows) -> DataFrame:
    """(doc, s, e, other, by): [s, e) of doc and [s + by, e + by) of other have equal hashes; links of the same two documents and distance are merged."""
    partner = F.when(F.col("doc") != F.col("first.doc"), F.col("first")).otherwise(F.col("last"))
    m = members.select("doc", (F.col("pos") - F.col("lead")).alias("s"), (F.col("pos") + w.gram + F.col("tail")).alias("e"), partner["doc"].alias("other"), (partner["pos"] - F.col("pos")).alias("by"))
    marked = m.selectExpr("*", "case when s <= max(e) over (partition by doc, other, by order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh")
    return marked.selectExpr("*", "sum(fresh) over (partition by doc, other, by order by s, e rows unbounded preceding) as run").groupBy("doc", "other", "by", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def _text_of(places: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """places (doc, s, e, ...) with at, the characters there, and n, the text's length."""
    src = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("__t")).filter("doc is not null and __t is not null")
    return places.join(src, "doc").select(*places.columns, F.char_length("__t").alias("n"), F.substring("__t", F.col("s") + 1, F.col("e") - F.col("s")).alias("at"))


def _parts_of_classes(classes: DataFrame, rows: DataFrame, docs: DataFrame, key: str, text: str, w: Windows) -> DataFrame:
    """(doc, s, e, n): what classes that stand in one document share with others of their hash.

    All stretches of `least` that hold a window overlap in it, so that from the first that is
    shared to the last all is.
    """
    one = classes.select(*_CLASS, F.col("first.doc").alias("doc"), F.col("last.doc").alias("to"), "first.pos", (F.col("first.pos") - F.col("lead")).alias("s"), (F.col("first.pos") + w.gram + F.col("first.tail")).alias("e"))
    near = _text_of(one, docs, key, text)
    each = near.select(*_CLASS, "doc", "to", "pos", "n", "at", F.explode(F.sequence(F.lit(0), F.col("e") - F.col("s") - w.least)).alias("o"))
    each = cut(each.select(*_CLASS, "doc", "to", "pos", "n", "o", F.unhex(F.sha2(F.substring("at", F.col("o") + 1, F.lit(w.least)), 256)).alias("digest")))
    several = each.groupBy("digest").agg(F.min("doc").alias("a"), F.max("to").alias("b")).filter("a != b").select("digest")
    reach = each.filter("doc = to").join(several, "digest").groupBy(*_CLASS, "doc", "n").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    s = F.col("pos") - F.col("lead")
    return rows.join(reach, [*_CLASS, "doc"]).select("doc", (s + F.col("lo")).alias("s"), (s + F.col("hi") + w.least).alias("e"), "n")
