"""Search: a query compiled to one boolean expression over one scan of the documents.

The whole tree becomes a Column, so Catalyst sees a single filter; the form with
semi-joins, unions and anti-joins is kept beside it as a check on the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.analysis import STOP_WORDS, WEIGHTS, stem, stem_column
from webloom.functions.text import tokens
from webloom.functions.uri import site
from webloom.plans.language import And, Not, Or, Phrase, Query, Site, Size, Term, parse

PAGE_SIZE = 20
SPATIAL_ROWS = 500


def _words(query: Term | Phrase) -> list[str]:
    return [query.word.lower()] if isinstance(query, Term) else [w.lower() for w in query.words]


def _stem_in(line: Column, word: str) -> Column:
    """Whether a line has a word with the stem of ``word``; only words with the stem's beginning are stemmed."""
    wanted = stem(word)
    near = F.regexp_extract_all(line, F.lit(rf"(?<= )(\Q{wanted[:-1]}\E[^ ]*)"), F.lit(1))
    return F.exists(near, lambda w: stem_column(w) == wanted)


def condition(query: Query, line: str = "_line", stemmed: bool = False) -> Column:
    """The query over a row with ``_line`` (its words in order, a blank before and after each), uri, js and css.

    A query of stop words alone, and the empty phrase, match nothing; in a negation they match everything.
    ``stemmed``: single words match all words of their stem; phrases hold their very words.
    """
    match query:
        case Term() | Phrase():
            wanted = _words(query)
            if not wanted or all(w in STOP_WORDS for w in wanted):
                return F.lit(False)
            if stemmed and len(wanted) == 1:
                return _stem_in(F.col(line), wanted[0])
            return F.col(line).contains(" " + " ".join(wanted) + " ")
        case Not(inner):
            return ~condition(inner, line, stemmed)
        case And(left, right):
            return condition(left, line, stemmed) & condition(right, line, stemmed)
        case Or(left, right):
            return condition(left, line, stemmed) | condition(right, line, stemmed)
        case Site(text):
            return F.coalesce(F.col("uri").contains(text), F.lit(False))
        case Size(prop, op, number):
            column = F.col(prop)
            return F.coalesce({"=": column == number, "<": column < number, ">": column > number}[op], F.lit(False))
    raise TypeError(query)


def with_line(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with ``_line``: one pass over the text serves every word and phrase of a query."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return documents.withColumn("_line", F.concat(F.lit(" "), words, F.lit(" ")))


def matching(documents: DataFrame, query: Query | str, text: str = "text", stemmed: bool = False) -> DataFrame:
    """The clean documents (flags = 0) that a query is true of, all columns."""
    q = parse(query) if isinstance(query, str) else query
    # the cheap filter stands before the words are made
    return with_line(documents.where("flags = 0"), text).where(condition(q, stemmed=stemmed)).drop("_line")


def matching_by_sets(documents: DataFrame, query: Query | str, text: str = "text") -> DataFrame:
    """doc_id of the same documents by set operations on identifiers: AND a semi-join, OR a union, NOT an anti-join."""
    q = parse(query) if isinstance(query, str) else query
    rows = with_line(documents.where("flags = 0"), text)

    def ids(q: Query) -> DataFrame:
        match q:
            case And(left, right):
                return ids(left).join(ids(right), "doc_id", "left_semi")
            case Or(left, right):
                return ids(left).union(ids(right)).distinct()
            case Not(inner):
                return rows.select("doc_id").join(ids(inner), "doc_id", "left_anti")
        return rows.where(condition(q)).select("doc_id")

    return ids(q).distinct()


def with_popularity(documents: DataFrame, domains: DataFrame) -> DataFrame:
    """documents with popularity: the best rank of their site, null if it has none."""
    ranks = domains.where("rank is not null").select(site(F.col("domain")).alias("_site"), "rank").groupBy("_site").agg(F.min("rank").alias("popularity"))
    return documents.withColumn("_site", site(F.col("domain"))).join(ranks, "_site", "left").drop("_site")


def query_words(query: Query) -> list[list[str]]:
    """The phrases (single words too) a document is ranked by: those that aren't negated."""
    match query:
        case Term() | Phrase():
            wanted = [w for w in _words(query) if w not in STOP_WORDS]
            return [wanted] if wanted else []
        case And(left, right) | Or(left, right):
            return query_words(left) + query_words(right)
    return []


#: Ways to normalise a rank, added up: by 1 + log of the length, by the length, by the distinct words, by 1 + their log, to rank / (rank + 1).
BY_LOG_LENGTH, BY_LENGTH, BY_WORDS, BY_LOG_WORDS, TO_ONE = 1, 2, 8, 16, 32


def _units(query: Query) -> list[tuple[str, ...]]:
    """The words and phrases of a conjunction, each once; those negated and those of stop words alone say nothing."""
    match query:
        case Term() | Phrase():
            wanted = tuple(_words(query))
            return [wanted] if wanted and not all(w in STOP_WORDS for w in wanted) else []
        case And(left, right):
            return list(dict.fromkeys(_units(left) + _units(right)))
    return []


def _branches(query: Query) -> list[list[tuple[str, ...]]]:
    """A query as a sum of conjunctions: OR is distributed over AND."""
    match query:
        case Or(left, right):
            return _branches(left) + _branches(right)
        case And(left, right):
            return [list(dict.fromkeys(a + b)) for a in _branches(left) for b in _branches(right)]
    return [_units(query)]


def _occurrences(words: Column, units: list[tuple[str, ...]], stemmed: bool) -> Column:
    """array of (last, first, unit), in order, of where a document has the units; positions count from 0."""

    def at(w: Column, i: Column) -> Column:
        found = []
        for k, unit in enumerate(units):
            if len(unit) > 1:
                here = (w == unit[0]) & (F.slice(words, i + 1, F.lit(len(unit))) == F.array(*map(F.lit, unit)))
            else:
                here = w.startswith(stem(unit[0])[:-1]) & (stem_column(w) == stem(unit[0])) if stemmed else w == unit[0]
            found.append(F.when(here, F.struct((i + len(unit) - 1).cast("int").alias("last"), i.cast("int").alias("first"), F.lit(k).alias("unit"))))
        return F.array_compact(F.array(*found))

    return F.array_sort(F.flatten(F.transform(words, at)))


def _cover_density(words: Column, weights: Column | None, units: list[tuple[str, ...]], stemmed: bool) -> Column:
    """Clarke, Cormack and Tudhope: each shortest stretch of words that holds all units adds their weights (1 each) over its length."""
    start = F.struct(F.array_repeat(F.lit(-1), len(units)).alias("at"), F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def step(acc: Column, e: Column) -> Column:
        at = F.transform(acc["at"], lambda x, j: F.when(j == e["unit"], e["first"]).otherwise(x))
        first = F.array_min(at)
        new = (first >= 0) & (first > acc["before"])
        gain = F.lit(float(len(units))) if weights is None else F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get(weights, i))
        return F.struct(at.alias("at"), F.when(new, first).otherwise(acc["before"]).alias("before"), (acc["total"] + F.when(new, gain / (e["last"] - first + 1)).otherwise(0.0)).alias("total"))

    return F.aggregate(_occurrences(words, units, stemmed), start, step, lambda acc: acc["total"])


def ranked(found: DataFrame, query: Query | str, text: str = "text", sections: list[tuple[str, str]] | None = None, normalisation: int = BY_LENGTH, stemmed: bool = False) -> DataFrame:
    """found with ranking: cover density by the query's tree, the sum over the branches of OR; only documents that were found are ranked.

    ``sections``: (label, column) pairs take the place of ``text``, and words weigh as their label. A document without
    words, and a query without a word that says anything, rank 0.
    """
    q = parse(query) if isinstance(query, str) else query
    parts = [tokens(F.coalesce(c, F.lit(""))) for _, c in sections or [("A", text)]]
    weights = F.concat(*[F.array_repeat(F.lit(WEIGHTS[label]), F.size(p)) for (label, _), p in zip(sections, parts, strict=True)]) if sections else F.lit(None)
    rows = found.withColumn("_words", F.concat(*parts)).withColumn("_weights", weights)
    branches = [b for b in _branches(q) if b]
    total = F.lit(0.0)
    for units in branches:
        total = total + _cover_density(F.col("_words"), F.col("_weights") if sections else None, units, stemmed)
    length, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    for bit, by in ((BY_LOG_LENGTH, 1 + F.log1p(length)), (BY_LENGTH, length), (BY_WORDS, distinct), (BY_LOG_WORDS, 1 + F.log1p(distinct))):
        if normalisation & bit:
            total = F.coalesce(F.try_divide(total, by), F.lit(0.0))
    if normalisation & TO_ONE:
        total = total / (total + 1)
    return rows.withColumn("ranking", total).drop("_words", "_weights")


def page(results: DataFrame, number: int = 1, size: int = PAGE_SIZE, ascending: bool = True) -> DataFrame:
    """A page of results, numbered from 1 (smaller numbers mean 1), by ranking and doc_id. A top-k, never a full sort."""
    order = F.asc("ranking") if ascending else F.desc("ranking")
    return results.orderBy(order, F.asc("doc_id")).offset((max(number, 1) - 1) * size).limit(size)


def pages_of(count: int, size: int = PAGE_SIZE) -> int:
    return max(1, math.ceil(count / size))


def snippet(text: str | None, wanted: list[str], max_fragments: int = 8, max_words: int = 12, min_words: int = 5, short_word: int = 2) -> str:
    """Fragments of a text around the wanted words, these in <b>, joined by dots; its beginning if there are none."""
    pieces = (text or "").split()
    plain = ["".join(c for c in p.lower() if c.isalnum()) for p in pieces]
    need = set(wanted)
    hits = [i for i, p in enumerate(plain) if p in need]
    if not hits:
        return " ".join(pieces[:max_words])
    fragments: list[tuple[int, int]] = []
    for i in hits:
        if fragments and i < fragments[-1][1]:
            continue
        if len(fragments) == max_fragments:
            break
        start = max(fragments[-1][1] if fragments else 0, i - (max_words - 1) // 2)
        end = min(len(pieces), start + max_words)
        # short words at the ends say little
        while end - start > min_words and len(plain[end - 1]) <= short_word and end - 1 > i:
            end -= 1
        while end - start > min_words and len(plain[start]) <= short_word and start < i:
            start += 1
        fragments.append((start, end))
    return " ... ".join(" ".join(f"<b>{pieces[k]}</b>" if plain[k] in need else pieces[k] for k in range(a, b)) for a, b in fragments)


def with_snippets(rows: DataFrame, query: Query | str, text: str = "text") -> DataFrame:
    """rows (a page of results) with snippet."""
    q = parse(query) if isinstance(query, str) else query
    wanted = [w for phrase in query_words(q) for w in phrase]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: snippet(t, wanted))

    return rows.withColumn("snippet", F.pandas_udf(run, "string")(text))
