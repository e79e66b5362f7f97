"""Distance vectors: an array with a slot for each root, null where the root doesn't reach the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_distance(slots: int) -> Column:
    return F.array_repeat(F.lit(None).cast("smallint"), slots)


def one_hot(slot: Column, slots: int) -> Column:
    """0 in one slot, null elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.when(i == slot, F.lit(0).cast("smallint")))


def increased(distance: Column) -> Column:
    return F.transform(distance, lambda x: (x + 1).cast("smallint"))


def least(a: Column, b: Column) -> Column:
    """Slot by slot the smaller; a null slot gives way to the other."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def all_less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x < y)


def all_true(flags: Column) -> Column:
    """True if every non-null flag is; null if there is none."""
    known = F.filter(flags, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.forall(known, lambda x: x))


def cardinality(distance: Column) -> Column:
    """How many roots reach the page; none if there is no vector."""
    return F.when(distance.isNull(), 0).otherwise(F.size(F.filter(distance, lambda x: x.isNotNull())))


def is_ancestor(a: Column, b: Column) -> Column:
    """Every slot known on both sides is smaller in a, and there is one."""
    return F.coalesce(all_true(all_less(a, b)), F.lit(False))
