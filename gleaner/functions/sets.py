"""Sets and maps held in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect_all(arrays: list[Column]) -> Column:
    """What all arrays hold, once each, in the order of the first."""
    return reduce(F.array_intersect, arrays)


def merged(maps: list[Column]) -> Column:
    """All keys of the maps; of a key that several have, the value of the last, even if that is null."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x)), maps)


def toggled(values: Column, x: Column) -> Column:
    """The array without x if it holds it, with x behind it if not."""
    return F.when(F.array_contains(values, x), F.array_remove(values, x)).otherwise(F.array_append(values, x))


def equal_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, in any order."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
