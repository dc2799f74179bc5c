"""Column functions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row: as a lambda's argument it is not worked out anew for every element that f goes through."""
    return F.get(F.transform(F.array(value), f), 0)


def total(values: Column) -> Column:
    """Sum of an array of doubles, in its order."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
