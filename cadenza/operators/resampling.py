"""Spearman's rho of resampled clusters for tables of any size: both sides are cut into slices.

Rows are counted pairs (key, g, x, y, n) of a cluster g. Replicates go in blocks of BLOCK. In a block

1. each cluster gets a vector of how often the replicates draw it, from the hash of the draws;
2. each row takes its cluster's vector times n: its weights, one a replicate. No row is copied;
3. weights are summed by value of x and of y inside partitions first, then by slices of values;
   sums of the slices before give the first rank of a slice, so every value gets its vector of
   ranks less their mean, and a slice its sum of squares;
4. rows take the rank vectors of their x and y, and products are summed in partitions, then by key.

No task holds more than a slice of values or a partition of rows. Joins deal out clusters and
values that hold many rows over SALTS copies of their vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import slices
from cadenza.operators.common import join_on, settled, spread

#: Replicates of a block, and different values of a slice.
BLOCK, VALUES = 50, 50_000


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _starts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where each group begins in it."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order, np.flatnonzero(new)


def _summed(rows: DataFrame, value: str, width: int) -> DataFrame:
    """(key, slice, v, w): weights by value, summed inside each batch of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, piece, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                order, first = _starts(v, np.unique(keys.astype(str), return_inverse=True)[1])
                w = np.add.reduceat(_vectors(batch.column(3), width)[order], first, axis=0)
                at = pa.array(order[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), _binary(w)], names=["key", "slice", "v", "w"])

    return rows.select("key", f"{value}_slice", value, "w").mapInArrow(add, "key string, slice long, v double, w binary")


def _ranks(rows: DataFrame, value: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(key, v, off): ranks less their mean of every value, and (key, total, squares), parts of each key's weight and sum of squares."""
    sums = settled(_summed(rows, value, width))

    def total(part: pa.Table) -> pa.Table:
        w = _vectors(part.column("w"), width).sum(axis=0, keepdims=True)
        return pa.table({"key": part.column("key").slice(0, 1), "slice": part.column("slice").slice(0, 1), "total": _binary(w)})

    def ahead(part: pa.Table) -> pa.Table:
        part = part.sort_by("slice")
        w = _vectors(part.column("total"), width)
        before = np.cumsum(w, axis=0) - w
        return pa.table({"key": part.column("key"), "slice": part.column("slice"), "before": _binary(before), "all": _binary(np.repeat(w.sum(axis=0, keepdims=True), len(w), axis=0))})

    totals = sums.groupBy("key", "slice").applyInArrow(total, "key string, slice long, total binary")
    starts = totals.groupBy("key").applyInArrow(ahead, "key string, slice long, before binary, all binary")  # a row a slice

    def rank(part: pa.Table, start: pa.Table) -> pa.Table:
        v = part.column("v").to_numpy()
        order, first = _starts(v)
        own = np.add.reduceat(_vectors(part.column("w"), width)[order], first, axis=0)
        whole = _vectors(start.column("all"), width)[0]
        off = _vectors(start.column("before"), width)[0] + np.cumsum(own, axis=0) - own + (own + 1) / 2 - (whole + 1) / 2
        none = [None] * (len(first) - 1)
        squares = pa.array([(own * off * off).sum(axis=0).tobytes(), *none], pa.binary())
        return pa.table({"key": part.column("key").take(pa.array(order[first])), "v": v[order[first]], "off": _binary(off), "squares": squares, "all": pa.array([whole.tobytes(), *none], pa.binary())})

    at = ["key", "slice"]
    ranked = settled(sums.groupBy(*at).cogroup(starts.groupBy(*at)).applyInArrow(rank, "key string, v double, off binary, squares binary, all binary"))
    return ranked.select("key", "v", "off"), ranked.where("squares IS NOT NULL").select("key", "squares", "all")


def sliced(counts: DataFrame, value: str) -> DataFrame:
    """counts with `<value>_slice`: slices of VALUES different values about, ascending."""
    few, many = slices.split(counts.select("key", value).distinct(), ["key"], [value], VALUES)
    if many is None:
        return counts.withColumn(f"{value}_slice", F.lit(0).cast("long"))
    named = few.withColumn("__slice", F.lit(0).cast("long")).unionByName(many.select("key", value, "__slice"))
    return spread(counts, settled(named), ["key", value]).withColumnRenamed("__slice", f"{value}_slice")


def _block(rows: DataFrame, draws: DataFrame, width: int, first: int) -> DataFrame:
    """(key, b, rho) of the replicates first, first + 1, ... draws: key, g, drawn (array of replicate * 2^32 + times)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, n = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_numpy()
            w = np.zeros((batch.num_rows, width))
            flat = drawn.flatten().to_numpy()
            w[np.repeat(np.arange(batch.num_rows), drawn.value_lengths().to_numpy()), (flat >> 32) - first] = flat & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _binary(w * n[:, None])], names=[*batch.schema.names[:-2], "w"])

    at = ["key", "x", "y", "x_slice", "y_slice"]
    weighed = spread(rows, draws, ["key", "g"]).select(*at, F.col("n").cast("double"), "drawn")
    weighed = settled(weighed.mapInArrow(weigh, "key string, x double, y double, x_slice long, y_slice long, w binary"))
    (off_x, sums_x), (off_y, sums_y) = _ranks(weighed, "x", width), _ranks(weighed, "y", width)
    both = spread(weighed.select("key", "x", "y", "w"), off_x.withColumnsRenamed({"v": "x", "off": "off_x"}), ["key", "x"])
    both = spread(both, off_y.withColumnsRenamed({"v": "y", "off": "off_y"}), ["key", "y"]).select("key", "w", "off_x", "off_y")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, of = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                w, a, b = (_vectors(batch.column(i), width) for i in (1, 2, 3))
                order, start = _starts(of)
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist()), _binary(np.add.reduceat((w * a * b)[order], start, axis=0))], names=["key", "products"])

    parts = both.mapInArrow(products, "key string, products binary")
    none = F.lit(None).cast("binary")
    parts = parts.select("key", "products", none.alias("xx"), none.alias("yy"), none.alias("all"))
    parts = parts.unionByName(sums_x.select("key", none.alias("products"), F.col("squares").alias("xx"), none.alias("yy"), "all"))
    parts = parts.unionByName(sums_y.select("key", none.alias("products"), none.alias("xx"), F.col("squares").alias("yy"), none.alias("all")))

    def rho(part: pa.Table) -> pa.Table:
        sums = {c: _vectors(part.column(c).drop_null(), width).sum(axis=0) for c in ("products", "xx", "yy")}
        whole = _vectors(part.column("all").drop_null(), width)[0]
        spread_ = np.sqrt(sums["xx"] * sums["yy"])
        flat = (spread_ < 1e-15) | (whole < 2)
        return pa.table({"key": pa.repeat(part.column("key")[0], width), "b": pa.array(np.arange(width) + first, pa.int32()), "rho": np.where(flat, 0.0, sums["products"] / np.where(flat, 1.0, spread_))})

    return parts.groupBy("key").applyInArrow(rho, "key string, b int, rho double")  # a vector a partition and slice


def rhos(counts: DataFrame, numbers: DataFrame, times: object, replicates: int) -> DataFrame:
    """(key, b, rho). counts: key, g, x, y, n; numbers: key, g, total; times(first, many): key, b, g, times of these replicates."""
    rows = settled(sliced(sliced(counts, "x"), "y"))
    out = None
    for first in range(0, replicates, BLOCK):
        width = min(BLOCK, replicates - first)
        packed = (F.col("b").cast("long") * F.lit(1 << 32) + F.col("times")).alias("d")
        draws = times(first, width).select("key", "g", packed).groupBy("key", "g").agg(F.collect_list("d").alias("drawn"))
        block = settled(_block(rows, settled(draws), width, first))
        out = block if out is None else out.unionByName(block)
    if out is None:
        return join_on(numbers, numbers.limit(0).select("key"), ["key"]).select("key", F.lit(0).alias("b"), F.lit(0.0).alias("rho"))
    return out
