"""Bootstraps and permutations: repetitions are rows, spread over tasks; the series is one of days and is sent to each.

A repetition draws from its own seeded generator, so that results don't depend on the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.operators.stats import one_series

def series(df: DataFrame, order: str, cols: list[str]) -> np.ndarray:
    one_series(df)
    return np.array([tuple(r) for r in df.select(order, *cols).orderBy(order).select(*cols).collect()], dtype=float).reshape(-1, len(cols))


def repeated(spark: SparkSession, data: np.ndarray, fn: Callable[[np.ndarray, np.random.Generator], float | None], reps: int, seed: int = 0) -> DataFrame:
    """(rep, value): fn(data, generator) of each repetition."""
    sent = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rep": b["id"], "value": [fn(sent.value, np.random.default_rng([seed, int(i)])) for i in b["id"]]}, columns=["rep", "value"]).astype({"value": "float64"})

    return spark.range(reps).mapInPandas(run, "rep bigint, value double")


def block_rows(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of a moving-block resample."""
    starts = rng.integers(0, max(n - block + 1, 1), -(-n // block))
    return (starts[:, None] + np.arange(min(block, n))).ravel()[:n]


def stationary_rows(n: int, horizon: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of a stationary resample: blocks of geometric length with mean `block`, around the end."""
    lengths = rng.geometric(1 / block, size=2 * -(-horizon // block))
    while lengths.sum() < horizon:
        lengths = np.append(lengths, rng.geometric(1 / block, size=len(lengths)))
    starts = rng.integers(0, n, len(lengths))
    ends = np.cumsum(lengths)
    rows = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
    return rows[:horizon] % n


def auc_value(y: np.ndarray, p: np.ndarray) -> float | None:
    n1 = y.sum()
    if n1 in (0, len(y)):
        return None
    ranks = pd.Series(p).rank().to_numpy()
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def auc_difference(df: DataFrame, order: str, y: str, a: str, b: str, block: int = 20, reps: int = 1000, seed: int = 0) -> tuple[float, float]:
    """The 95 % interval of auc(b) - auc(a), what b adds to a, by moving blocks; repetitions with one class only are left out."""

    def one(d: np.ndarray, rng: np.random.Generator) -> float | None:
        s = d[block_rows(len(d), block, rng)]
        x = auc_value(s[:, 0], s[:, 1])
        return None if x is None else auc_value(s[:, 0], s[:, 2]) - x

    r = repeated(df.sparkSession, series(df.dropna(subset=[y, a, b]), order, [y, a, b]), one, reps, seed)
    lo, hi = r.filter(~F.isnan("value")).agg(F.percentile("value", F.lit(0.025)), F.percentile("value", F.lit(0.975))).first()
    return lo, hi


def win_probability(df: DataFrame, order: str, excess: str, horizon: int, block: int = 60, reps: int = 5000, seed: int = 0) -> float:
    """How often the sum of horizon resampled days is above 0."""
    one = lambda d, rng: float(d[stationary_rows(len(d), horizon, block, rng), 0].sum() > 0)
    return repeated(df.sparkSession, series(df.dropna(subset=[excess]), order, [excess]), one, reps, seed).agg(F.avg("value")).first()[0]


def permutation_percentile(df: DataFrame, order: str, ret: str, position: str, reps: int = 2000, seed: int = 0) -> float | None:
    """The share of shuffles of position with a mean gross return, position * (e^ret - 1), below the actual one; null if all positions are equal."""
    data = series(df.dropna(subset=[ret, position]).select(order, F.expm1(ret).alias(ret), position), order, [ret, position])
    if len(set(data[:, 1])) < 2:
        return None
    actual = float((data[:, 0] * data[:, 1]).mean())
    one = lambda d, rng: float((d[:, 0] * rng.permutation(d[:, 1])).mean() < actual)
    return repeated(df.sparkSession, data, one, reps, seed).agg(F.avg("value")).first()[0]
