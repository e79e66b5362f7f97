"""Problem 8: documents packed into containers of fixed token capacities, by hierarchical multi-length packing.

Documents are routed to tiers of context sizes by their length. The longest tier is packed first,
largest items first; the gap of each window is filled from the shorter tiers before these are packed themselves.
Sizes are whole numbers up to the capacity, so the packing is planned on
the histogram of sizes (a few thousand numbers, however many documents there are): a plan is a list of patterns
(sizes that share a container) with multiplicities. Every item then finds its container from
its rank among the items of its size; ranks come from counts per part, so no size's
items are ever brought together.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.written import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TIERS = (512, 2048)
#: Items per part within which ranks are counted.
PART_ITEMS = 200_000


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens of the whole text; null and empty texts have none. ``tokenizer`` is a file of base64 tokens and ranks, there on every node."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"]]})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(count, "doc_id long, tokens long")


def plan(histogram: dict[int, int], tiers: Sequence[int] = TIERS) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Patterns as (tier, first container, number of containers, [(size, items of it in one container)]).

    Largest first, the fullest fit next. A container is opened for the largest item left, in the tier (its own or a longer one) whose
    window is then filled best; its gap takes the largest items left that fit, from its own tier and the shorter ones.
    """
    tiers = sorted(tiers)
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    sizes = np.array(sorted(left), np.int64)

    def filled(tier: int) -> tuple[dict[int, int], int]:
        """Items by size that greedily fill a window of a tier, the largest item first, and the room that is left."""
        pattern: dict[int, int] = {}
        room, end = tier, len(sizes)
        while end := int(np.searchsorted(sizes[:end], room, side="right")):
            s = int(sizes[end - 1])
            pattern[s] = min(room // s, left[s])
            room -= pattern[s] * s
            end -= 1
        return pattern, room

    patterns, container = [], 0
    while len(sizes):
        fits = [(t, *filled(t)) for t in tiers if t >= sizes[-1]]
        tier, pattern, _ = min(fits, key=lambda f: (round(f[2] / f[0], 3), f[0]))
        times = min(left[s] // k for s, k in pattern.items())
        patterns.append((tier, container, times, list(pattern.items())))
        container += times
        for s, k in pattern.items():
            left[s] -= k * times
        sizes = np.array([s for s in sizes.tolist() if left[s]], np.int64) if any(not left[s] for s in pattern) else sizes
    return patterns


class Assignment:
    """Container of an item by its size and its rank (from 0) among the items of that size."""

    def __init__(self, patterns: list[tuple[int, int, int, list[tuple[int, int]]]]) -> None:
        used: dict[int, int] = defaultdict(int)
        rows = []
        for tier, first, times, content in patterns:
            for s, k in content:
                rows.append((s, used[s], first, times, tier))
                used[s] += k * times
        rows.sort()
        self.size, self.start, self.first, self.times, self.tier = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        #: sizes are below 2^20, ranks below 2^43
        self.key = (self.size << 43) + self.start

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """container, tier"""
        at = np.searchsorted(self.key, (size.astype(np.int64) << 43) + rank, side="right") - 1
        return self.first[at] + (rank - self.start[at]) % self.times[at], self.tier[at]


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, size: a document within the capacity is one piece; a larger one is cut into full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("long")
    cut = counts.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("size"))


def ranked(items: DataFrame, total: int, part_items: int = PART_ITEMS) -> DataFrame:
    """items with rank: 0, 1, ... among the items of a size, counted in parts by the hash of doc_id."""
    parts = max(1, -(-total // part_items))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    # capacity times parts rows
    offsets = items.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("size", "part").orderBy("doc_id", "piece")) - 1
    return items.withColumn("place", place).join(offsets.select("size", "part", before.alias("before")), ["size", "part"]).withColumn("rank", F.col("place") + F.col("before"))


def pack(documents: DataFrame, tiers: Sequence[int] = TIERS, step_containers: int = 64, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, first_token, size, tier, container, step of every document with tokens.

    A document is split only if it exceeds the largest tier. Containers are dealt to steps of about step_containers
    in turn, so that every step gets the same mix of tiers and fills. Null and empty texts
    take no room and have no row; repeated rows are items of their own. An empty table gives no rows.
    """
    counts = written(token_counts(documents, tokenizer))
    items = pieces(counts, max(tiers))
    # at most one row per size, whatever the number of documents
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    patterns = plan(histogram, tiers)
    assignment = Assignment(patterns)
    containers = sum(p[2] for p in patterns)
    steps = max(1, -(-containers // step_containers))
    largest = max(tiers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            container, tier = assignment.find(batch["size"].to_numpy(), batch["rank"].to_numpy()) if len(batch) else (np.empty(0, np.int64),) * 2
            # containers are numbered from long to short and from full to empty windows
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "piece": batch["piece"], "first_token": batch["piece"] * largest, "size": batch["size"], "tier": tier,
                "container": container, "step": container % steps,
            })

    schema = "doc_id long, piece long, first_token long, size long, tier long, container long, step long"
    return ranked(items, sum(histogram.values())).select("doc_id", "piece", "size", "rank").mapInPandas(place, schema)


def fill_rates(packed: DataFrame) -> DataFrame:
    """tier, containers, items, tokens, fill (share of the room that is used)."""
    each = packed.groupBy("tier", "container").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    return each.groupBy("tier").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * F.col("tier"))).alias("fill")
    )
