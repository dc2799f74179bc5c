"""Spans against points and other spans, by an index of bins.

Places are cut into bins of WIDTH. A span is copied to the bins that it touches, a point lies in
one, and both meet by an equi-join on key and bin, so a row meets what is near it instead of all
of its key. Two spans that share several bins are counted in the bin where the later one starts.
Spans are half open; rows with a null key or end, and spans without a place in them, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a bin. A span of many bins has a copy in each, which meets up to WIDTH places there.
WIDTH = 64


def _bin(place: Column | str, width: int) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / width).cast("long")


def _bins(start: str, stop: str, width: int) -> Column:
    """Bins of a span; none if it is empty."""
    a, b = F.col(start), F.col(stop)
    return F.when(a < b, F.sequence(_bin(start, width), _bin(b - 1, width))).otherwise(F.array().cast("array<bigint>"))


def _keyed(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__of_{k}" for k in key})


def _same(key: list[str]) -> Column:
    on = F.col("__bin") == F.col("__at")
    for k in key:
        on = on & (F.col(k) == F.col(f"__of_{k}"))
    return on


def points_in(spans: DataFrame, points: DataFrame, key: list[str], start: str, stop: str, place: str, width: int = WIDTH) -> DataFrame:
    """spans with each point of their key whose place they cover, and the point's other columns."""
    copies = spans.withColumn("__bin", F.explode(_bins(start, stop, width)))
    found = copies.join(_keyed(points, key).withColumn("__at", _bin(place, width)), _same(key))
    return found.where((F.col(place) >= F.col(start)) & (F.col(place) < F.col(stop))).drop("__bin", "__at", *[f"__of_{k}" for k in key])


def overlapping(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str], right_span: tuple[str, str], how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal keys whose spans share a place, each once: all columns of left, and those of right but the key. Other names must differ.

    how: inner, or left, which also gives copies of the left rows without the right's columns, at least one of each row without a partner.
    """
    (a, b), (c, d) = left_span, right_span
    copies = left.withColumn("__bin", (F.explode if how == "inner" else F.explode_outer)(_bins(a, b, width)))
    others = _keyed(right, key).withColumn("__at", F.explode(_bins(c, d, width)))
    share = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__bin") == _bin(F.greatest(a, c), width))
    return copies.join(others, _same(key) & share, how).drop("__bin", "__at", *[f"__of_{k}" for k in key])
