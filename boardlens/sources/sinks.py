"""Where results go: tables by partition, files written once, chunks that resume."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """df as Parquet, one file per partition value, in place of what was there."""
    w = (df.repartition(*by) if by else df).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_new(df: DataFrame, path: str, force: bool = False) -> None:
    """df as CSV with a header; refused where there is a file, unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def resume(spark: SparkSession, todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(todo) appended to path, for the keys that aren't there yet; the whole of it is returned.

    A run that broke off goes on where its last finished append ended.
    """
    try:
        done = spark.read.parquet(path)
        todo = todo.join(done.select(key).distinct(), key, "left_anti")
    except AnalysisException:
        pass
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)
