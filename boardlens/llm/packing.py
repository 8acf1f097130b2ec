"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths, best fit on counts: as many decisions as there are
lengths and kinds of container, however many documents. Then each document takes the planned slot
of its rank among the documents of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.session import cut

#: Documents of one length that one task ranks.
RANKED_TOGETHER = 500_000
#: Ranks of a length that are joined to slots under one key.
CELL = 4096


def byte_tokens(text: Column) -> Column:
    """Tokens of a byte-level tokenizer without special tokens: one per UTF-8 byte."""
    return F.octet_length(text)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(slots, containers): best fit decreasing, for all items of a length at once.

    counts: length -> number of items, lengths from 1 to capacity. A slot (length, first, until,
    container, each, at) says that the items of that length with rank first <= r < until lie in
    container + (r - first) // each, from token at + (r - first) % each * length on. Longest
    lengths come first; each takes the containers with the least room that is enough, then new
    ones. A run of containers with equal content is one entry throughout, so that the plan has a
    few entries per length.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    slots: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[i]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # fewer than each, in one container
                    slots.append((length, rank, rank + left, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, n - full)
    return slots, made


def pack(df: DataFrame, key: str, length: Column, capacity: int) -> DataFrame:
    """(key, piece, pieces, start, length, container, at): where each item lies; one row per piece.

    An item is one piece unless it is longer than capacity; then it is split into pieces of
    capacity and a rest. start is a piece's first token in its item, at its first token in the
    container. Items of length 0 or null need no room: one row with piece 0, pieces 0 and null
    container. key is unique; of items with equal length, each share by hash takes slots in the order of key; rows that
    repeat a key are items of their own. Extra columns are left out. An empty table gives none.

    What reaches the driver is the histogram, at most capacity numbers, and the plan made of it.
    Ranks come from counts per length and share of it, a share being a bounded part of the
    items by hash, so that a length that a third of all items have is ranked by many tasks. Slots
    and items meet by length and cell of ranks; as the plan has a few entries per length, the
    ranks that an item is compared with and that aren't its own are bounded by plan and cell, not
    by the items.
    """
    items = df.select(F.col(f"`{key}`").alias("__key"), length.cast("bigint").alias("__n"))
    pieces = F.when(F.coalesce("__n", F.lit(0)) <= 0, 0).otherwise(F.ceil(F.col("__n") / F.lit(capacity))).cast("int")
    all_pieces = items.withColumn("pieces", pieces).select("__key", "__n", "pieces", F.explode(F.expr("sequence(0, greatest(pieces - 1, 0))")).alias("piece"))
    size = F.when(F.col("pieces") == 0, 0).when(F.col("piece") < F.col("pieces") - 1, capacity).otherwise(F.col("__n") - F.col("piece").cast("bigint") * capacity)
    all_pieces = cut(all_pieces.select("__key", "pieces", "piece", size.cast("int").alias("length")))
    sized = all_pieces.filter("length > 0")
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    shares = -(-max(counts.values(), default=1) // RANKED_TOGETHER)
    slots, _ = plan(counts, capacity)
    sized = sized.withColumn("__share", F.pmod(F.xxhash64("__key", "piece"), F.lit(shares)).cast("int"))
    before = F.expr("sum(__c) over (partition by length order by __share rows between unbounded preceding and 1 preceding)")
    offsets = sized.groupBy("length", "__share").agg(F.count("*").alias("__c")).select("length", "__share", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = sized.withColumn("__rank", F.expr("row_number() over (partition by length, __share order by __key, piece) - 1")).join(offsets, ["length", "__share"])
    ranked = ranked.select("__key", "pieces", "piece", "length", (F.col("__rank") + F.col("__before")).alias("__rank"))
    table = df.sparkSession.createDataFrame(slots, "length int, __first bigint, __until bigint, __base bigint, __each bigint, __used int")
    table = table.withColumn("__cell", F.explode(F.expr(f"sequence(__first div {CELL}, (__until - 1) div {CELL})")))
    k = F.col("__rank") - F.col("__first")
    met = ranked.withColumn("__cell", F.expr(f"__rank div {CELL}")).join(table, ["length", "__cell"]).filter("__rank >= __first and __rank < __until")
    placed = met.select("__key", "pieces", "piece", "length", (F.col("__base") + F.expr("(__rank - __first) div __each")).alias("container"), (F.col("__used") + k % F.col("__each") * F.col("length")).cast("int").alias("at"))
    none = all_pieces.filter("length = 0").select("*", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("at"))
    return placed.unionByName(none).select(F.col("__key").alias(key), "piece", "pieces", (F.col("piece").cast("bigint") * capacity).alias("start"), "length", "container", "at")
