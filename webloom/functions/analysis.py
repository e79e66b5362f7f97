"""Text analysis for search: tokens, stop words, stems, weighted positions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import tokens

#: Words that say nothing in a query.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few "
    "for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with you your yours yourself yourselves"
).split()

#: Labels of a document's sections, from the weightiest.
LABELS = ("A", "B", "C", "D")
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def simple_words(text: Column) -> Column:
    """Lower-case words in order, position being the index."""
    return tokens(text)


_VOWEL = re.compile(r"[aeiouy]")
_ENDINGS = (("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ement", ""), ("ment", ""), ("ness", ""))


def stem(word: str) -> str:
    """A light English suffix stripper: plurals, -ed and -ing, a few noun endings. Short words stay."""
    if len(word) <= 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith(("ss", "us")):
        word = word[:-1]
    for ending in ("ed", "ing"):
        rest = word.removesuffix(ending)
        if rest != word and len(rest) > 2 and _VOWEL.search(rest) and not rest.endswith("e"):
            if rest.endswith(("at", "bl", "iz")):
                rest += "e"
            elif rest[-1] == rest[-2] and rest[-1] not in "aeiouylsz":
                rest = rest[:-1]
            word = rest
            break
    if word.endswith("y") and len(word) > 3 and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for ending, to in _ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word.removesuffix(ending) + to
    return word


def _plural(word: Column) -> Column:
    return F.when(word.rlike("(?:sses|ies)$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def _verb(word: Column) -> Column:
    rest = F.regexp_replace(word, "(?:ed|ing)$", "")
    cut = (rest != word) & (F.length(rest) > 2) & rest.rlike("[aeiouy]") & ~rest.endswith("e")
    return F.when(~cut, word).when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e"))).when(rest.rlike("([^aeiouylsz])\\1$"), F.regexp_replace(rest, ".$", "")).otherwise(rest)


def _noun(word: Column) -> Column:
    return F.when(word.rlike("[aeiouy].*y$") & (F.length(word) > 3), F.regexp_replace(word, "y$", "i")).otherwise(word)


def _ended(word: Column) -> Column:
    return F.coalesce(*[F.when(word.rlike(f"^.{{3,}}{ending}$"), F.regexp_replace(word, f"{ending}$", to)) for ending, to in _ENDINGS], word)


def stem_column(word: Column) -> Column:
    """The same stems as an expression, so that words are stemmed within the JVM."""
    stems = F.array(word)
    # each step names the last one's result, which would be spelled out again at each mention otherwise
    for step in (_plural, _verb, _noun, _ended):
        stems = F.transform(stems, step)
    return F.when(F.length(word) <= 3, word).otherwise(F.get(stems, F.lit(0)))


def stem_table(words: DataFrame, column: str = "word") -> DataFrame:
    """word, stem of every distinct word: the vocabulary is stemmed, not every occurrence."""
    return words.select(F.col(column).alias("word")).where("word is not null").distinct().select("word", stem_column(F.col("word")).alias("stem"))


def _labelled(words: Column, offset: Column, label: str) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (offset + i).cast("int").alias("position"), F.lit(label).alias("label")))


def weighted_vector(sections: list[tuple[str, Column]], analyse: Callable[[Column], Column] = simple_words) -> Column:
    """array of (word, position, label) over labelled sections in order; positions go on across sections, stop words keep theirs but are left out."""
    offset, parts = F.lit(0), []
    for label, text in sections:
        words = analyse(F.coalesce(text, F.lit("")))
        parts.append(_labelled(words, offset, label))
        offset = offset + F.size(words)
    return F.filter(F.concat(*parts), lambda e: ~e["word"].isin(STOP_WORDS))
