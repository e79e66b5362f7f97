"""An inverted index as a table, for searches that must not read the texts.

A posting is (bucket, term, doc_id, positions). Written by bucket and sorted by term, a word's postings are a few row groups
of one folder: the filter on bucket prunes folders, the one on term row groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.analysis import STOP_WORDS
from webloom.functions.text import tokens
from webloom.operators.search import condition
from webloom.plans.language import And, Not, Or, Phrase, Query, Term, parse

BUCKETS = 64


def build_postings(documents: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, doc_id, positions of every word, stop words included, as phrases hold them; a document's words are gathered where it is, so nothing is exchanged but postings."""
    words = documents.where("doc_id is not null").select("doc_id", F.posexplode(tokens(F.coalesce(text, F.lit("")))).alias("position", "term"))
    # positions of one word in one document: bounded by the document
    postings = words.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    return postings.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "doc_id", "positions")


def write_postings(postings: DataFrame, path: str, files_per_bucket: int = 4) -> None:
    """One folder per bucket; within its files the terms are in order, so their row groups hold few terms. A hot term goes over several files."""
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_bucket))
    postings.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _postings_of(postings: DataFrame, term: str, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.lit(term)), F.lit(buckets)).cast("int")
    return postings.where((F.col("bucket") == bucket) & (F.col("term") == term)).select("doc_id", "positions")


def _minus(shift: int) -> Callable[[Column], Column]:
    return lambda p: p - F.lit(shift)


def _phrase(postings: DataFrame, words: list[str], buckets: int) -> DataFrame:
    """doc_id of documents with the words side by side."""
    # the first word that is no stop word keeps the intermediate rows few
    asked = sorted(enumerate(words), key=lambda x: (x[1] in STOP_WORDS, x[0]))
    first, starts = asked[0][0], _postings_of(postings, asked[0][1], buckets)
    for i, w in asked[1:]:
        other = _postings_of(postings, w, buckets).withColumnRenamed("positions", "other")
        moved = F.transform("other", _minus(i - first))
        starts = starts.join(other, "doc_id").select("doc_id", F.array_intersect("positions", moved).alias("positions")).where(F.size("positions") > 0)
    return starts.select("doc_id")


def search_postings(postings: DataFrame, documents: DataFrame, query: Query | str, buckets: int = BUCKETS) -> DataFrame:
    """doc_id of the clean documents that a query is true of; words come from the index, site and size conditions from the documents' narrow columns."""
    q = parse(query) if isinstance(query, str) else query
    clean = documents.where("flags = 0")

    def ids(q: Query) -> DataFrame:
        match q:
            case Term() | Phrase():
                words = [q.word.lower()] if isinstance(q, Term) else [w.lower() for w in q.words]
                if all(w in STOP_WORDS for w in words):
                    return clean.where("false").select("doc_id")
                return _phrase(postings, words, buckets)
            case And(left, right):
                return ids(left).join(ids(right), "doc_id", "left_semi")
            case Or():
                return reduce(DataFrame.union, map(ids, _branches(q))).distinct()
            case Not(inner):
                return clean.select("doc_id").join(ids(inner), "doc_id", "left_anti")
        return clean.where(condition(q)).select("doc_id")

    return clean.select("doc_id").join(ids(q), "doc_id", "left_semi").distinct()


def _branches(q: Query) -> list[Query]:
    return _branches(q.left) + _branches(q.right) if isinstance(q, Or) else [q]
