"""Values inherited along chains of rows, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.session import cut


def inherit(nodes: DataFrame, key: Sequence[str], parent: Sequence[str], value: str) -> DataFrame:
    """(key, value): each node's value, or where it is null that of its nearest ancestor that has one.

    key is unique; parent holds the key of a node's parent, null for a root. A parent that isn't
    in nodes ends the chain. Each round doubles the distance that open pointers span, so that a
    chain of n nodes without value takes log2(n) joins on key; no chain, however long, is gathered
    in one task. What a round moves ends in the shared folder, the rest stays where it is; rounds
    stop when nothing is open.
    """
    up_key, up_parent = [f"__u{i}" for i in range(len(key))], [f"__v{i}" for i in range(len(key))]
    is_open = F.col(value).isNull() & F.col(parent[0]).isNotNull()
    whole = cut(nodes.select(*key, *parent, value))
    done, todo = whole.filter(~is_open), whole.filter(is_open)
    while True:
        if todo.isEmpty():
            return done.select(*key, value)
        state = done.unionByName(todo)
        up = state.select(*[F.col(k).alias(u) for k, u in zip(key, up_key, strict=True)], *[F.col(p).alias(v) for p, v in zip(parent, up_parent, strict=True)], F.col(value).alias("__value"))
        on = F.lit(True)
        for p, u in zip(parent, up_key, strict=True):
            on = on & (F.col(p) == F.col(u))
        moved = todo.join(up, on, "left").select(*key, *[F.when(F.col("__value").isNull(), F.col(v)).alias(p) for p, v in zip(parent, up_parent, strict=True)], F.col("__value").alias(value))
        moved = cut(moved)
        done, todo = done.unionByName(moved.filter(~is_open)), moved.filter(is_open)
