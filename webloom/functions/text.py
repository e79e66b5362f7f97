"""Text functions as Column expressions, so that they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because the JVM's \\s is ASCII only.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def collapse_space(text: Column) -> Column:
    """Without surrounding white space, every inner run of white space one blank."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_count(text: Column) -> Column:
    """Words between runs of Unicode white space; null stays null, the empty text has none."""
    trimmed = collapse_space(text)
    return F.when(text.isNull(), F.lit(None).cast("int")).when(trimmed == "", F.lit(0)).otherwise(
        F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    ).cast("int")


def letters_only(text: Column) -> Column:
    """The letters in order, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, as an array without empty strings."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")
