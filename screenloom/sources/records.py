"""JSON records, feature tables and reusable snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature table with its vector column."""
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so a reader of one split never opens the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    table = spark.read.parquet(path)
    return table.filter(table[split] == name)


def snapshot(
    spark: SparkSession,
    path: str,
    required: Sequence[str],
    build: Callable[[], DataFrame],
    refresh: bool = False,
) -> DataFrame:
    """The table stored at ``path`` if it has the required columns, else build and store it."""
    if not refresh:
        try:
            stored = spark.read.parquet(path)
            if set(required) <= set(stored.columns):
                return stored
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
