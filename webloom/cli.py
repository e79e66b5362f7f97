"""``python -m webloom.cli JOB FOLDER [OUT]``: a maintenance job over a folder of tables, its result written as parquet or shown."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom import api
from webloom.operators import graph, maintenance, signals, titles
from webloom.session import get_spark
from webloom.sources import imports
from webloom.sources.tables import read_table as t


def _distances(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.page_edges(t(spark, d, "edges"), t(spark, d, "discovery"))
    start = graph.vector_rows(graph.incoming_distance(t(spark, d, "discovery")), "doc_id")
    return graph.as_vectors(graph.relax_distances(start, edges, 9), 9)


def _answers(spark: SparkSession, path: str) -> DataFrame:
    """Fetched popularity answers: domain, status, body."""
    return imports.popularity_answers(spark.read.parquet(path)).select("domain", "rank")


#: Jobs that take a second table from outside (--from).
IMPORTS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "import-popularity": lambda s, d, path: maintenance.imported_ranks(t(s, d, "domains"), imports.popularity_csv(s, path)),
    "backfill-popularity": lambda s, d, path: maintenance.backfilled_ranks(t(s, d, "domains"), _answers(s, path)),
    "backfill-robot-rules": lambda s, d, path: maintenance.backfilled_rules(t(s, d, "domains"), imports.parsed_robots(s.read.parquet(path), "webloom")),
    "reindex": lambda s, d, path: signals.indexed_documents(signals.document_flags(signals.signals(imports.read_pages(s, path)))),
}
JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "purge": lambda s, d: maintenance.purged_documents(t(s, d, "documents")),
    "purge-discovery": lambda s, d: maintenance.purged_discovery(t(s, d, "discovery")),
    "batch-titles": lambda s, d: titles.best_titles(t(s, d, "title_edges"), t(s, d, "title_segs")),
    "backfill-distance": _distances,
    "title-edges": lambda s, d: titles.new_title_edges(t(s, d, "documents"), t(s, d, "title_segs"), t(s, d, "title_edges"))[1],
    "clean-edges": lambda s, d: maintenance.distinct_edges(t(s, d, "edges")),
    "home": lambda s, d: api.home(t(s, d, "documents"), t(s, d, "discovery")),
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="webloom")
    parser.add_argument("job", choices=[*JOBS, *IMPORTS, "search"])
    parser.add_argument("folder")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--from", dest="source", default="", help="the list, answers, files or pages of an import")
    parser.add_argument("--query", default="")
    parser.add_argument("--page", type=int, default=1)
    a = parser.parse_args(arguments)
    spark = get_spark()
    if a.job == "search":
        result = api.discover(t(spark, a.folder, "documents"), t(spark, a.folder, "domains"), a.query, a.page)[1]
    elif a.job in IMPORTS:
        result = IMPORTS[a.job](spark, a.folder, a.source)
    else:
        result = JOBS[a.job](spark, a.folder)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(truncate=80)


if __name__ == "__main__":
    main()
