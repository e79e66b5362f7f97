"""Ranking dimensions: scores in [0, 1) as expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from webloom.functions.fixed import ASSET_THRESHOLDS, POPULARITY_THRESHOLDS, UNKNOWN_POPULARITY, WORD_THRESHOLDS


def stratify(value: Column, thresholds: Sequence[int]) -> Column:
    """Piecewise linear: each stratum between thresholds has an equal share of [0, 1); from the last threshold on there is no score."""
    k, low, score = len(thresholds), 0, F.when(F.lit(False), F.lit(0.0))
    for i, high in enumerate(thresholds):
        score = score.when(value < high, (F.lit(float(i)) + (value.cast("double") - low) / float(high - low)) / float(k))
        low = high
    return score


def uniform_rank(value: Column, tie: Column) -> Column:
    """Ordinal over (n - 1), ascending, ties by the other column; 1 if there is one row. Over the whole result, so use it on a page of results."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy().orderBy(value.asc(), tie.asc()))
    return F.when(n == 1, F.lit(1.0)).otherwise((place - 1).cast("double") / F.greatest(n - 1, F.lit(1)).cast("double"))


#: Name of a dimension -> its score over the columns of a search result.
DIMENSIONS: dict[str, Callable[[], Column]] = {
    "js": lambda: stratify(F.col("js"), ASSET_THRESHOLDS),
    "css": lambda: stratify(F.col("css"), ASSET_THRESHOLDS),
    "assets": lambda: stratify(F.coalesce("js", F.lit(0)) + F.coalesce("css", F.lit(0)), ASSET_THRESHOLDS),
    "words": lambda: stratify(F.col("word_count"), WORD_THRESHOLDS),
    "relevance": lambda: uniform_rank(F.col("ranking"), F.col("doc_id")),
    "popularity": lambda: stratify(F.coalesce("popularity", F.lit(UNKNOWN_POPULARITY)), POPULARITY_THRESHOLDS),
}
