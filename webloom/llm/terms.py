"""Problem 1: occurrences and records of every term, by last-seen counters.

Tokens are hash-partitioned by term and ordered by record. Going through one
term's tokens in that order, a record is new exactly when it differs from the
last one seen, so a term needs three numbers (occurrences, records, last record)
and no set of records. A hot term is split by a salt made of its record, so that
all tokens of a record meet in one part and the parts' counts simply add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import collapse_space

SALTS, JOIN_SALTS = 32, 8


def normal_term(text: Column) -> Column:
    return collapse_space(F.lower(text))


def last_seen_counts(tokens: DataFrame, term: str = "term", record: str = "record", weight: str | None = None, salts: int = SALTS) -> DataFrame:
    """term, occurrences, records of a (term, record) table; extra columns are ignored.

    Rows with a null term or record don't count. Repeated rows count as
    occurrences, not as records. ``weight`` names a column with a row's
    occurrences, if rows are already counted. An empty table gives no rows.
    """
    rows = tokens.select(
        F.col(term).alias("term"), F.col(record).alias("record"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")
    ).where("term is not null and record is not null")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int"))
    # one term's part, ordered by record: the window is the pass with the last-seen counter
    seen = F.lag("record").over(Window.partitionBy("term", "salt").orderBy("record"))
    parts = salted.withColumn("new", F.when(seen.eqNullSafe(F.col("record")), 0).otherwise(1))
    return (
        parts.groupBy("term", "salt")
        .agg(F.sum("n").alias("occurrences"), F.sum("new").alias("records"))
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def record_total(tokens: DataFrame, record: str = "record") -> DataFrame:
    """One row: the number of distinct records (partial aggregates shrink the exchange)."""
    return tokens.select(F.col(record).alias("record")).where("record is not null").distinct().agg(F.count("*").alias("n_records"))


def mark_terms(counts: DataFrame, total: DataFrame, rare_records: int = 1, common_share: float = 0.02) -> DataFrame:
    """counts with ``mark``: ``rare`` up to rare_records, ``common`` strictly above common_share of all records, else null."""
    # total is one row by construction, so this is no join that grows
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.col("n_records") * F.lit(common_share), "common")
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark)


def segment_tokens(title_edges: DataFrame, title_segs: DataFrame) -> DataFrame:
    """term, record of the title edges whose document isn't null and whose segment has a row."""
    edges = title_edges.select(F.col("doc").alias("record"), F.col("seg").alias("seg_id")).where("record is not null and seg_id is not null")
    segs = title_segs.select(F.col("id").alias("seg_id"), normal_term(F.col("seg")).alias("term")).where("term is not null").distinct()
    # a segment that a third of the pages have is joined in parts
    segs = segs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(JOIN_SALTS)).cast("int")).join(segs, ["seg_id", "salt"]).select("term", "record")


def term_frequencies(title_edges: DataFrame, title_segs: DataFrame) -> DataFrame:
    """term, occurrences, records, n_records, mark over all title segments."""
    tokens = segment_tokens(title_edges, title_segs)
    return mark_terms(last_seen_counts(tokens), record_total(tokens))
