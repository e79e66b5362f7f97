"""The requests a reader makes, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import frontier, graph, layout, search


def home(documents: DataFrame, discovery: DataFrame) -> DataFrame:
    return frontier.home_counts(documents, discovery)


def discover(documents: DataFrame, domains: DataFrame, query: str, page: int = 1) -> tuple[DataFrame, DataFrame]:
    """One row with the total, and the page of results with snippets. The total is counted apart, so a page beyond the last still has it."""
    found = search.matching(documents, query)
    results = search.with_popularity(search.ranked(found, query), domains)
    rows = search.with_snippets(search.page(results, page), query)
    return found.agg(F.count("*").alias("total")), rows.select("doc_id", "uri", "title", "word_count", "popularity", "ranking", "snippet")


def discover_map(documents: DataFrame, domains: DataFrame, query: str, x: str = "words", y: str = "assets", z: str = "relevance", width: int = 1920) -> DataFrame:
    """The map of the first results of a query."""
    results = search.with_popularity(search.ranked(search.matching(documents, query), query), domains)
    best = search.page(results, 1, search.SPATIAL_ROWS)
    return layout.placed(layout.boxes(layout.scored(best, x, y, z), width), width)


def reverse(documents: DataFrame, edges: DataFrame, discovery: DataFrame, vectors: DataFrame, uri: str) -> DataFrame:
    """What leads to a page: the forest of its ancestors."""
    start = documents.where(F.col("uri") == uri).select(F.col("doc_id").alias("node"))
    neighbours = graph.reverse_neighbours(graph.page_edges(edges, discovery), vectors)
    return graph.reverse_closure(neighbours, start)
