"""Helpers shared by the corpus-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsloom.operators.tables import written

#: Rows of a table up to which it is broadcast; what is larger is joined, skewed keys being split at runtime.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deliveries_once(df: DataFrame, key: str) -> DataFrame:
    """One row per key: redelivered rows carry the same content, so any of them will do."""
    return df.dropDuplicates([key])


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df written once, to be broadcast where its counted rows are within the limit."""
    kept = written(df)
    return F.broadcast(kept) if kept.count() <= limit else kept


__all__ = ["deliveries_once", "few", "table", "written"]
