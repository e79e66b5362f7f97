"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "domains discovery edges title_segs title_edges labels benchmark"
).split()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named table of a folder; columns are pruned and filters pushed down by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
