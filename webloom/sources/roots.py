"""The root sites that discovery starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.arrays import null_distance, one_hot
from webloom.functions.fixed import ROOT_SITES


def root_nodes(spark: SparkSession, sites: Sequence[str] = ROOT_SITES) -> DataFrame:
    """uri, depth 0, distance: 0 in the root's own slot; the vectors are as long as the list."""
    rows = spark.createDataFrame(list(enumerate(sites)), "slot int, uri string")
    return rows.select("uri", F.lit(0).alias("depth"), one_hot(F.col("slot"), len(sites)).alias("distance"))


def with_roots(discovery: DataFrame, sites: Sequence[str] = ROOT_SITES) -> DataFrame:
    """id, uri, depth, distance with the roots in: a known address keeps its id and depth and gets the root's distance; others get null vectors of the right length if they have none."""
    # imported here: maintenance is no source
    from webloom.operators.maintenance import with_new_ids

    roots = root_nodes(discovery.sparkSession, sites)
    narrow = discovery.select("id", "uri", "depth", F.coalesce("distance", null_distance(len(sites))).alias("distance"))
    known = narrow.join(F.broadcast(roots.select("uri", F.col("distance").alias("root"))), "uri", "left")
    known = known.select("id", "uri", "depth", F.coalesce("root", "distance").alias("distance"))
    missing = with_new_ids(roots.join(narrow.select("uri"), "uri", "left_anti"), narrow, "id", ["uri"], 1)
    return known.unionByName(missing.select("id", "uri", "depth", "distance"))
