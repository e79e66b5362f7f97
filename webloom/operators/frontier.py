"""The crawl frontier and the counts of the home page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_frontier(discovery: DataFrame) -> DataFrame:
    """Addresses neither resolved nor dead."""
    return discovery.where(F.col("canonical").isNull() & ~F.col("dead"))


def next_to_explore(discovery: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """id, uri, depth of the k shallowest open addresses; among equals by chance, or by a hash if a seed makes it repeatable."""
    chance: Column = F.rand() if seed is None else F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    return open_frontier(discovery).orderBy("depth", chance, "id").limit(k).select("id", "uri", "depth")


def home_counts(documents: DataFrame, discovery: DataFrame) -> DataFrame:
    """One row: clean and polluted documents, discovered addresses."""
    pages = documents.agg(F.count_if(F.expr("flags = 0")).alias("indexed"), F.count_if(F.expr("flags <> 0")).alias("polluted"))
    return pages.crossJoin(discovery.agg(F.count("*").alias("discovered")))


def unranked_domains(domains: DataFrame) -> DataFrame:
    return domains.where("rank is null")


def with_commas(number: Column) -> Column:
    return F.format_number(number, 0)
