"""Deliveries and daily amounts as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardlens.operators import rolling


def first_deliveries(stream: DataFrame, key: str, time: str, within: str = "30 days") -> DataFrame:
    """The first delivery of each identifier as it arrives; an identifier is remembered for `within` of event time, so that state stays bounded.

    A stream can't take back what it gave out: this keeps the first, redelivery.keep_one the last.
    """
    named = stream.filter(F.col(key).isNotNull()).withColumn("__key", F.trim(F.col(key)))
    return named.withWatermark(time, within).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def rolling_corrections(state_path: str, keys: Sequence[str], periods: Sequence[int] = (7, 30)):
    """A function for foreachBatch: late amounts (keys, day, sum, n, nz) become new versions in the state at state_path.

    Versions are named by batch, so that a batch that runs again writes the same files again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/*")
        newest = state.groupBy(*keys, "day").agg(F.max_by(F.struct(*[c for c in state.columns if c not in (*keys, "day")]), "version").alias("s")).select(*keys, "day", "s.*")
        rolling.correct(newest, batch, keys, periods).write.mode("overwrite").parquet(f"{state_path}/batch={epoch + 1}")

    return apply
