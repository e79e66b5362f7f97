"""The link graph: depth, distance vectors, joins of roots, closures and forests."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.arrays import cardinality, increased, is_ancestor
from webloom.plans.written import written

#: Rounds after which the parts of a result are merged.
COMPACT = 6


def page_edges(edges: DataFrame, discovery: DataFrame) -> DataFrame:
    """src, dst as documents: an edge leads to a discovered address, which leads to the document it is canonical for."""
    known = discovery.where("canonical is not null").select(F.col("id").alias("dst"), F.col("canonical").alias("page"))
    return edges.where("src is not null and dst is not null").join(known, "dst").select("src", F.col("page").alias("dst")).distinct()


def incoming_depth(discovery: DataFrame) -> DataFrame:
    """doc_id, depth: the smallest depth at which a document's addresses were met."""
    return discovery.where("canonical is not null").groupBy(F.col("canonical").alias("doc_id")).agg(F.min("depth").alias("depth"))


def incoming_distance(discovery: DataFrame) -> DataFrame:
    """doc_id, distance: the vector with the smallest component among a document's addresses, one hop on; ties to the smaller id."""
    rows = discovery.where("canonical is not null").select(F.col("canonical").alias("doc_id"), "id", "distance", F.coalesce(F.array_min("distance"), F.lit(32767)).alias("nearest"))
    best = F.min_by("distance", F.struct("nearest", "id"))
    return rows.groupBy("doc_id").agg(best.alias("distance")).select("doc_id", increased(F.col("distance")).alias("distance"))


def relax_distances(distances: DataFrame, edges: DataFrame, slots: int, max_rounds: int | None = None) -> DataFrame:
    """node, slot, hops: the fixpoint of hops over edges (src, dst) from the rows given, as one row for each reached slot.

    Each round extends only what was improved in the last one and appends it to what is known; every COMPACT rounds the
    parts are merged into one. Rounds are written tables in the shared folder: their size is known to the planner,
    so a small frontier is broadcast to the edges, and only a large one has them exchanged. Cycles and repeated edges do no harm.
    A bound on the rounds that is met before the fixpoint is an error.
    """
    frontier = written(_nearest(distances.where("hops is not null").select("node", "slot", F.col("hops").cast("int").alias("hops"))))
    parts = [frontier]
    steps = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    for done in count():
        met = _nearest(frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), "slot", (F.col("hops") + 1).alias("hops")))
        known = _nearest(reduce(DataFrame.unionByName, parts)).withColumnRenamed("hops", "known")
        frontier = written(met.join(known, ["node", "slot"], "left").where("known is null or hops < known").select("node", "slot", "hops"))
        if frontier.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        parts.append(frontier)
        if len(parts) > COMPACT:
            parts = [written(_nearest(reduce(DataFrame.unionByName, parts)))]
    return _nearest(reduce(DataFrame.unionByName, parts))


def _nearest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "slot").agg(F.min("hops").alias("hops"))


def as_vectors(best: DataFrame, slots: int) -> DataFrame:
    """node, distance: the reached slots as one vector."""
    parts = [F.min(F.when(F.col("slot") == i, F.col("hops"))).cast("smallint") for i in range(slots)]
    return best.groupBy("node").agg(F.array(*parts).alias("distance"))


def vector_rows(vectors: DataFrame, node: str, distance: str = "distance") -> DataFrame:
    """node, slot, hops of vectors."""
    return vectors.select(F.col(node).alias("node"), F.posexplode(distance).alias("slot", "hops")).where("hops is not null")


def improvable_edges(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """src, dst of edges whose source is reached by more roots than their target: where distances still have to flow."""
    a = vectors.select(F.col("node").alias("src"), cardinality(F.col("distance")).alias("src_card"))
    b = vectors.select(F.col("node").alias("dst"), cardinality(F.col("distance")).alias("dst_card"))
    return edges.join(a, "src").join(b, "dst").where("src_card > dst_card").select("src", "dst", "src_card", "dst_card")


def join_pages(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """src, dst of edges into a page that more roots reach than its source, both being reached: where roots' regions join."""
    a = vectors.select(F.col("node").alias("src"), cardinality(F.col("distance")).alias("src_card"))
    b = vectors.select(F.col("node").alias("dst"), cardinality(F.col("distance")).alias("dst_card"))
    return edges.join(a, "src").join(b, "dst").where("src_card > 0 and src_card < dst_card").select("src", "dst", "src_card", "dst_card")


def reverse_neighbours(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """dst, src of edges whose source is an ancestor: nearer to every root that both are reached from."""
    a = vectors.select(F.col("node").alias("src"), F.col("distance").alias("a"))
    b = vectors.select(F.col("node").alias("dst"), F.col("distance").alias("b"))
    return edges.join(a, "src").join(b, "dst").where(is_ancestor(F.col("a"), F.col("b"))).select("dst", "src").distinct()


def reverse_closure(neighbours: DataFrame, start: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, level, parent of everything reached backwards from the start nodes: a forest by breadth, parents being the smallest of the level before.

    A bound on the levels that is met before the end is an error.
    """
    kind = neighbours.schema["src"].dataType
    frontier = written(start.select(F.col("node").cast(kind).alias("node")).distinct().withColumn("level", F.lit(0)).withColumn("parent", F.lit(None).cast(kind)))
    parts, steps = [frontier], written(neighbours)
    for level in count(1):
        met = frontier.select(F.col("node").alias("dst")).join(steps, "dst").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
        seen = reduce(DataFrame.unionByName, parts).select("node")
        frontier = written(met.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level"), "parent"))
        if frontier.isEmpty():
            break
        if max_rounds is not None and level > max_rounds:
            raise RuntimeError(f"more than {max_rounds} levels")
        parts.append(frontier)
        if len(parts) > COMPACT:
            parts = [written(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)
