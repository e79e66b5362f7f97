"""Flags and features of documents as bit masks."""

from __future__ import annotations

from enum import IntFlag
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class DocumentFlag(IntFlag):
    DISALLOWED_BY_ROBOTS = 1
    PROHIBITED_URI = 2
    NEWS = 4
    SHOPPING = 8
    PAYWALLED = 16
    LISTICLE = 32
    MEDIA = 64
    ANTICOMPETITIVE_TECH = 128
    ADS = 256


class DocumentFeature(IntFlag):
    MATH = 1
    CODE = 2
    FORUM = 4


def flag_if(flag: IntFlag, condition: Column) -> Column:
    return F.when(condition, F.lit(int(flag))).otherwise(F.lit(0)).cast("long")


def union(*masks: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks)


def names(mask: Column, kind: type[IntFlag]) -> Column:
    """The names of the set bits, in the order of the bits."""
    all_names = F.array(*[F.when(mask.bitwiseAND(F.lit(int(f))) != 0, F.lit(f.name.lower())) for f in kind])
    return F.array_compact(all_names)
