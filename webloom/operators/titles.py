"""Titles: cut into segments, and the segment that tells a page apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.fixed import TITLE_SEPARATORS
from webloom.operators.maintenance import get_or_insert, with_new_ids


def title_segments(title: Column) -> Column:
    """Segments in order: cut at the separators, then at `` - ``, then at ``. ``; trimmed, empty ones dropped.

    The cuts come one after the other: what a later one would join with an earlier one differs from a single alternation.
    """
    by_sign = F.split(title, "[" + re.escape(TITLE_SEPARATORS) + "]")
    by_dash = F.flatten(F.transform(by_sign, lambda s: F.split(s, " - ")))
    by_stop = F.flatten(F.transform(by_dash, lambda s: F.split(s, r"\. ")))
    return F.filter(F.transform(by_stop, lambda s: F.regexp_replace(s, r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")), lambda s: s != "")


def segments_of(documents: DataFrame) -> DataFrame:
    """doc_id, position, seg"""
    return documents.select("doc_id", F.posexplode(title_segments(F.col("title"))).alias("position", "seg"))


def new_title_edges(documents: DataFrame, title_segs: DataFrame, title_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What indexing documents adds: (id, seg) of unknown segments, and (id, doc, seg, text) of edges that aren't stored under any id of their segment."""
    wanted = segments_of(documents.where("title is not null")).select(F.col("doc_id").alias("doc"), F.col("seg").alias("text")).distinct()
    ids = get_or_insert(title_segs, wanted.withColumnRenamed("text", "seg"), "id", "seg").select(F.col("id").alias("seg"), F.col("seg").alias("text"))
    stored = title_edges.where("doc is not null and seg is not null").select("doc", F.col("seg").alias("id")).join(title_segs.select("id", F.col("seg").alias("text")), "id").select("doc", "text")
    edges = wanted.join(stored, ["doc", "text"], "left_anti").join(ids, "text")
    added = ids.select(F.col("text").alias("seg"), F.col("seg").alias("id")).join(title_segs.select("seg"), "seg", "left_anti").select("id", "seg")
    return added, with_new_ids(edges, title_edges, "id", ["doc", "seg"]).select("id", "doc", "seg", "text")


def segment_counts(title_edges: DataFrame) -> DataFrame:
    """seg, n: how many pages carry a segment; repeated edges count once."""
    return title_edges.where("doc is not null and seg is not null").select("doc", "seg").distinct().groupBy("seg").agg(F.count("*").alias("n"))


def best_titles(title_edges: DataFrame, title_segs: DataFrame) -> DataFrame:
    """doc, best_title, n: of a page's segments the one with the fewest pages, ties to the smaller segment id.

    A page has few segments, so the window is over small groups; a hot segment is only counted.
    """
    edges = title_edges.where("doc is not null and seg is not null").select("doc", "seg").distinct()
    segs = title_segs.groupBy(F.col("id").alias("seg")).agg(F.min("seg").alias("text"))
    ranked = edges.join(segment_counts(title_edges), "seg").join(segs, "seg")
    best = F.min_by(F.struct("text", "n"), F.struct("n", "seg"))
    return ranked.groupBy("doc").agg(best.alias("b")).select("doc", F.col("b.text").alias("best_title"), F.col("b.n").alias("n"))


def with_best_titles(documents: DataFrame, title_edges: DataFrame, title_segs: DataFrame) -> DataFrame:
    """documents whose title is the best segment, where there is one; blank titles stay."""
    best = best_titles(title_edges, title_segs).select(F.col("doc").alias("doc_id"), "best_title")
    return documents.join(best, "doc_id", "left").withColumn("title", F.when(F.trim("title") != "", F.coalesce("best_title", "title")).otherwise(F.col("title"))).drop("best_title")


def pages_per_segment_count(title_edges: DataFrame) -> DataFrame:
    """doc, segments: edges of each page, as the batch job counts them."""
    return title_edges.where("doc is not null").groupBy("doc").agg(F.count("*").alias("segments"))


def shown_title(title: Column, most: int = 37) -> Column:
    """Cut to the width of the map, with dots."""
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("..."))).otherwise(title)


def placeholder(title: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("(no title)")).otherwise(title)


def rarest_first(title_edges: DataFrame, title_segs: DataFrame) -> DataFrame:
    """doc, seg, place: a page's segments by rarity."""
    edges = title_edges.where("doc is not null and seg is not null").select("doc", "seg").distinct().join(segment_counts(title_edges), "seg")
    known = title_segs.select(F.col("id").alias("seg")).distinct()
    return edges.join(known, "seg", "left_semi").select("doc", "seg", F.row_number().over(Window.partitionBy("doc").orderBy("n", "seg")).alias("place"))
