"""Problem 9: evaluation items inside the corpus, by template canonicalisation.

Every word is either one of the templates' own words or a typed placeholder: a
number, a unit, or a name (a word that the items write with a capital within a sentence and nowhere
without). In the corpus the items' names are names in any case, and so are other words with a capital. Windows of
``WINDOW`` words are hashed in that form, so an item is met again when its numbers and
names were changed; the corpus is joined to the items by those hashes.
Then the slots are compared: within a passage each value must stand for one value of the item, and
the other way round, numbers for numbers, units for units, names for names; a passage is cut where that fails.
If all slots are filled alike the passage is the item's own, which is what the exact check asks for.
A window with few own words says nothing as a template, so it keeps its very words.

The items are the stated query set: they are taken in blocks whose tables go to every task,
and the corpus is only scanned, without any exchange of its rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
#: Own words that a window needs to be used as a template.
MIN_OWN_WORDS = 5
#: Items whose windows go to the tasks at once; larger sets are done in several passes.
BLOCK_ITEMS = 2_000
#: Units that may change together with their number.
UNITS = frozenset(
    "mm cm dm m km inch inches foot feet yard yards mile miles league leagues g kg lb lbs pound pounds ton tons tonne tonnes l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years euro euros dollar dollars mark marks cent cents percent".split()
)
WORD = re.compile(r"[^\W_]+")
NUMBER, UNIT, NAME, OWN = 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)

LEAK_SCHEMA = "doc_id long, item_id long, exact_words int, template_words int, matched_words int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


_SENTENCE_END = frozenset(".!?…:\n\"“”«»")


def capitals(text: str, count: int) -> list[bool]:
    """Whether each of the words of a text starts with a capital; nowhere, if lower case cuts the text into other words."""
    found = [w[0].isupper() for w in WORD.findall(text)]
    return found if len(found) == count else [False] * count


def name_evidence(text: str | None) -> tuple[set[str], set[str]]:
    """Words with a capital within a sentence, and words in lower case, of one item."""
    words = words_of(text)
    within, lower = set(), set()
    if words and len(words) == len(matches := list(WORD.finditer(text))):
        for w, m in zip(words, matches, strict=True):
            if not m[0][0].isupper():
                lower.add(w)
            elif m.start() and not _SENTENCE_END.intersection(text[max(0, m.start() - 3) : m.start()]):
                within.add(w)
    else:
        lower.update(words)
    return within, lower


def rolling(codes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of all runs of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * _BASE + codes[k : k + n]
        return total ^ (total >> np.uint64(29))


class ItemIndex:
    """Template windows of a block of items: hash -> (item, place).

    ``names`` are the name words of the whole set of items; without it the block is the whole set.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW, min_own: int = MIN_OWN_WORDS, names: Iterable[str] | None = None) -> None:
        self.window, self.min_own = window, min_own
        items = list(items)
        self.items = [(i, words_of(t)) for i, t in items]
        if names is None:
            evidence = [name_evidence(t) for _, t in items]
            names = set().union(*(e[0] for e in evidence)).difference(*(e[1] for e in evidence))
        names = set(names)
        numbers = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}.union(names, UNITS)))}
        self.exact = {w: k + 1 for w, k in numbers.items()}
        self.template = {w: UNIT if w in UNITS else NUMBER if w[0].isdigit() else NAME if w in names else OWN + k for w, k in numbers.items()}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, ws) in enumerate(self.items):
            for q, h in enumerate(self.hashes(*self.codes(ws)).tolist()):
                if h:
                    self.places[h].append((at, q))
        self.known = np.array(sorted(self.places), np.uint64)

    def codes(self, words: list[str], text: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """exact and template codes; 0 is a word that no item has, or no placeholder. ``text`` tells which unknown words have a capital."""
        exact = np.fromiter(map(self.exact.get, words, repeat(0)), np.uint64, len(words))
        template = np.fromiter(map(self.template.get, words, repeat(0)), np.uint64, len(words))
        unknown = np.flatnonzero(template == 0).tolist()
        capital = capitals(text, len(words)) if text and unknown else None
        for k in unknown:
            template[k] = NUMBER if words[k][0].isdigit() else NAME if capital and capital[k] else 0
        return exact, template

    def hashes(self, exact: np.ndarray, template: np.ndarray) -> np.ndarray:
        """A hash for each window; 0 where it can't match."""
        own = np.concatenate([[0], np.cumsum(template >= OWN)])
        foreign = np.concatenate([[0], np.cumsum(template == 0)])
        out = np.concatenate([[0], np.cumsum(exact == 0)])
        as_template = rolling(template, self.window) | np.uint64(1)
        as_words = rolling(exact, self.window) & ~np.uint64(1)
        few = own[self.window :] - own[: -self.window] < self.min_own
        as_words[out[self.window :] - out[: -self.window] > 0] = 0
        as_template[foreign[self.window :] - foreign[: -self.window] > 0] = 0
        return np.where(few, as_words, as_template)

    def longest_consistent(self, here: list[str], there: list[str]) -> int:
        """The longest stretch in which slots are filled one to one; 0 if it is shorter than a window, or neither the item's very words nor with enough own ones."""
        best = start = 0
        filled: dict[str, tuple[str, int]] = {}
        fills: dict[str, tuple[str, int]] = {}
        for k, (a, b) in enumerate(zip(here, there, strict=True)):
            if a != b and (self.template[b] >= OWN or self.kind(a) != self.template[b]):
                start = k + 1
            elif self.template[b] < OWN:
                # what contradicts this filling lies before the stretch from here on
                for known, this, other in ((filled, b, a), (fills, a, b)):
                    if this in known and known[this][0] != other:
                        start = max(start, known[this][1] + 1)
                filled[b], fills[a] = (a, k), (b, k)
            if k + 1 - start > best:
                told = sum(self.template[x] >= OWN for x in there[start : k + 1])
                if k + 1 - start >= self.window and (told >= self.min_own or here[start : k + 1] == there[start : k + 1]):
                    best = k + 1 - start
        return best

    def kind(self, word: str) -> int:
        """The type of a word in a slot; an unknown one that was matched is a number or a name."""
        return self.template.get(word) or (NUMBER if word[0].isdigit() else NAME)

    def leaks(self, words: list[str], matched: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """item, exact words, template words, matched words of one document; matched are the places of its windows in the index."""
        by_line: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p in matched.tolist():
            for at, q in self.places[int(hashes[p])]:
                by_line[at, p - q].append(p)
        best: dict[int, tuple[int, int, int]] = {}
        for (at, shift), places in by_line.items():
            item_words = self.items[at][1]
            start = 0
            for k in range(1, len(places) + 1):
                if k < len(places) and places[k] == places[k - 1] + 1:
                    continue
                first, last = places[start], places[k - 1] + self.window
                start = k
                here, there = words[first:last], item_words[first - shift : last - shift]
                run = most = 0
                for a, b in zip(here, there, strict=True):
                    run = run + 1 if a == b else 0
                    most = max(most, run)
                e, t, m = best.get(at, (0, 0, 0))
                best[at] = (max(e, most if most >= self.window else 0), max(t, self.longest_consistent(here, there)), max(m, last - first))
        for at, (e, t, m) in best.items():
            yield self.items[at][0], e, t, m


def _scan(index: ItemIndex):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if len(words) < index.window:
                    continue
                hashes = index.hashes(*index.codes(words, text))
                near = np.searchsorted(index.known, hashes)
                near[near == len(index.known)] = 0
                matched = np.flatnonzero((index.known[near] == hashes) & (hashes != 0))
                if len(matched):
                    found += [(doc_id, *x) for x in index.leaks(words, matched, hashes)]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "exact_words", "template_words", "matched_words"])

    return run


def name_words(items: DataFrame) -> list[str]:
    """The words that all items together use as names only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, n) for t in batch["text"] for n, words in zip((1, 0), name_evidence(t), strict=True) for w in words]
            yield pd.DataFrame(rows, columns=["word", "name"])

    words = items.select("text").mapInPandas(run, "word string, name int").groupBy("word").agg(F.min("name").alias("name")).where("name = 1")
    return [r["word"] for r in words.select("word").collect()]  # at most the vocabulary of the items


def find_leaks(documents: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, exact_words, template_words, matched_words of every document and item that share a window of ``window`` words as a template.

    ``matched_words`` is the longest passage that matches as a template, ``template_words`` the longest part of one whose slots are
    filled one to one, 0 if no window is, and ``exact_words`` the longest run of the item's very words, 0 if shorter than a window.
    Null, empty and short texts and items share nothing. Repeated documents rows give repeated rows; an item without windows is never leaked.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates()
    corpus = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    total = items.count()
    blocks = max(1, -(-total // block_items))
    # what is a placeholder must not depend on the cut into blocks
    names = name_words(items) if blocks > 1 else None
    result = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        index = ItemIndex([tuple(r) for r in part.collect()], window, names=names)  # a block of the query set, block_items or so
        found = corpus.mapInPandas(_scan(index), LEAK_SCHEMA) if len(index.known) else spark.createDataFrame([], LEAK_SCHEMA)
        result = found if result is None else result.unionByName(found)
    return result
