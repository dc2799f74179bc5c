"""Batches of samples of like length.

Plans depend on lengths only, so they are made from the histogram of lengths: as many
rows as there are different lengths, as maps that compose. Rows then find their batch by
their place among rows of equal length; no task sees all samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import slices

SLICES = 64
#: Different lengths that a task packs.
LENGTHS = 20_000


def _histogram(df: DataFrame, length: str) -> DataFrame:
    return df.groupBy(length).agg(F.count(F.lit(1)).alias("__n"))


def _placed(df: DataFrame, length: str, order: str, plan: DataFrame) -> DataFrame:
    """df with the plan of its length and __pos, its place by order among rows of that length.

    Where order is a number, quantiles of it cut the rows into slices, so that a length that very many rows share is not left to one task.
    """
    joined = df.join(plan.withColumnRenamed(length, "__len"), F.col(length) == F.col("__len"))
    if not isinstance(df.schema[order].dataType, T.NumericType):
        return joined.withColumn("__pos", F.row_number().over(W.partitionBy(length).orderBy(order)) - 1)
    cuts = F.broadcast(df.agg(F.percentile_approx(order, [i / SLICES for i in range(1, SLICES)]).alias("__cuts")))  # one row
    slice_of = F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    sizes = df.crossJoin(cuts).select(F.col(length).alias("__l"), slice_of.alias("__i")).groupBy("__l", "__i").agg(F.count(F.lit(1)).alias("__m"))
    sizes = sizes.withColumn("__ahead", F.coalesce(F.sum("__m").over(W.partitionBy("__l").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sliced = joined.crossJoin(cuts).withColumn("__slice", slice_of).drop("__cuts")
    placed = sliced.join(sizes, (F.col(length) == F.col("__l")) & (F.col("__slice") == F.col("__i")))
    return placed.withColumn("__pos", F.col("__ahead") + F.row_number().over(W.partitionBy(length, "__slice").orderBy(order)) - 1)


def fixed_batches(df: DataFrame, length: str, order: str, size: int, out: str = "batch") -> DataFrame:
    """Sorted by length (ties by order), cut into batches of size."""
    plan = _histogram(df, length).withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(length).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return _placed(df, length, order, plan).select(*df.columns, F.floor((F.col("__before") + F.col("__pos")) / max(size, 1)).alias(out))


class Packing:
    """Greedy packing of samples that come by length, ascending: what a length does to the open batch.

    A batch takes the next sample while it has under max_samples and (size + 1) * heads * length^2 stays
    within budget; a sample over the budget is a batch of its own. Among samples of one length every batch
    but the first is cut at the same size, so a length maps the size of the open batch to its size after it
    and a number of new batches. Such maps compose, so slices of lengths need not wait for each other.
    """

    def __init__(self, budget: int, max_samples: int, heads: int) -> None:
        self.budget, self.most, self.heads = budget, max(1, max_samples), heads

    def cap(self, length: int) -> int:
        square = self.heads * length * length
        return max(1, min(self.most, self.budget // square if square > 0 else self.most))

    def step(self, size: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of every size of the open batch (0: none): size after n samples of this length, new batches, samples that join the open one; and the length's cap."""
        cap = self.cap(length)
        joins = np.where(size > 0, np.clip(cap - size, 0, n), 0)
        rest = n - joins
        new = -(-rest // cap)
        return np.where(rest > 0, rest - (new - 1) * cap, size + joins), new, joins, cap

    def composed(self, lengths: list[int], counts: list[int], widest: int) -> tuple[np.ndarray, np.ndarray]:
        """The map of a slice of lengths for open batches of 0 to widest samples."""
        size, new = np.arange(widest + 1), np.zeros(widest + 1, np.int64)
        for length, n in zip(lengths, counts):
            size, more, _, _ = self.step(size, length, n)
            new += more
        return size, new

    def steps(self, lengths: list[int], counts: list[int], size: int, batch: int) -> Iterator[tuple[int, int, int, int]]:
        """(length, joins, cap, batch) of a slice's lengths; batch: the one that is open when the length comes."""
        at = np.array([size])
        for length, n in zip(lengths, counts):
            at, new, joins, cap = self.step(at, length, n)
            yield length, int(joins[0]), cap, batch
            batch += int(new[0])


def packing_plan(histogram: DataFrame, length: str, budget: int, max_samples: int, heads: int) -> DataFrame:
    """length, __joins, __cap, __b of every length of a histogram (length, __n).

    Slices of LENGTHS different lengths are composed to one map each, maps are applied in order (a row a
    slice), and each slice then gives its own lengths' rows. The open batch's size is bounded by max_samples and the cap of the shortest length.
    """
    pack = Packing(budget, max_samples, heads)
    hist = histogram.select(F.lit(1).alias("__all"), F.col(length).cast("long").alias("f"), "__n")
    few, many = slices.split(hist, ["__all"], ["f"], LENGTHS)
    sliced = few.withColumn("__slice", F.lit(0).cast("long")) if many is None else many
    shortest = histogram.agg(F.min(F.abs(F.col(length)))).first()[0]
    widest = pack.cap(shortest) if shortest is not None else 1

    def compose(part: pa.Table) -> pa.Table:
        part = part.sort_by("f")
        size, new = pack.composed(part.column("f").to_pylist(), part.column("__n").to_pylist(), widest)
        return pa.table({"__slice": part.column("__slice").slice(0, 1), "size": pa.array([size.astype("<i8").tobytes()], pa.binary()), "new": pa.array([new.tobytes()], pa.binary())})

    def enter(part: pa.Table) -> pa.Table:
        size, batch, out = 0, -1, []
        for row in part.sort_by("__slice").to_pylist():
            out.append((row["__slice"], size, batch))
            size, batch = int(np.frombuffer(row["size"], "<i8")[size]), batch + int(np.frombuffer(row["new"], "<i8")[size])
        return pa.table({"__slice": [r[0] for r in out], "size": [r[1] for r in out], "batch": [r[2] for r in out]})

    def steps(part: pa.Table, entry: pa.Table) -> pa.Table:
        part = part.sort_by("f")
        rows = list(pack.steps(part.column("f").to_pylist(), part.column("__n").to_pylist(), entry.column("size")[0].as_py(), entry.column("batch")[0].as_py()))
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("f", "__joins", "__cap", "__b"))})

    maps = sliced.groupBy("__slice").applyInArrow(compose, "__slice long, size binary, new binary")
    entries = maps.withColumn("__all", F.lit(1)).groupBy("__all").applyInArrow(lambda t: enter(t), "__slice long, size long, batch long")
    plan = sliced.groupBy("__slice").cogroup(entries.groupBy("__slice")).applyInArrow(steps, "f long, __joins long, __cap long, __b long")
    return plan.withColumnRenamed("f", length)


def attention_budget_batches(df: DataFrame, length: str, order: str, budget: int, max_samples: int, heads: int, out: str = "batch") -> DataFrame:
    """Greedy packing of samples sorted by length (see Packing)."""
    plan = packing_plan(_histogram(df, length), length, budget, max_samples, heads)
    late = F.col("__pos") - F.col("__joins")
    return _placed(df, length, order, plan).select(*df.columns, F.when(late < 0, F.col("__b")).otherwise(F.col("__b") + 1 + F.floor(late / F.col("__cap"))).cast("long").alias(out))


def padded(df: DataFrame, batch: str, values: str, pad: float = 0.0) -> DataFrame:
    """values padded to the longest of its batch, and mask (true: padding)."""
    longest = F.max(F.size(values)).over(W.partitionBy(batch))
    missing = longest - F.size(values)
    return df.withColumns({"padded": F.concat(F.col(values), F.array_repeat(F.lit(pad), missing)), "mask": F.concat(F.array_repeat(F.lit(False), F.size(values)), F.array_repeat(F.lit(True), missing))})


def epoch_order(batches: DataFrame, batch: str, epoch: int, seed: int = 42) -> DataFrame:
    """Batches with a seeded place for the epoch; members stay together.

    The order is by md5(seed + epoch : batch). Its first three digits cut it into slices, which are counted first.
    """
    hashed = batches.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed + epoch), F.col(batch)))).withColumn("__s", F.substring("__h", 1, 3))
    sizes = hashed.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))  # 4,096 rows at most
    sizes = sizes.select(F.col("__s").alias("__slice"), F.coalesce(F.sum("__n").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = hashed.join(F.broadcast(sizes), F.col("__s") == F.col("__slice"))
    return placed.withColumn("place", F.col("__before") + F.row_number().over(W.partitionBy("__s").orderBy("__h", batch)) - 1).select(*batches.columns, "place")
