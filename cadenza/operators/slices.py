"""Sequences of any length without a window over a whole sequence.

A sequence is a key and an order of its rows. Sequences of up to ROWS rows are windows of their key.
A longer one is cut into slices: rows whose hash of key and order falls on a multiple are its
sample, quantiles of the sample are the cuts, and slices that are still too long are cut again.
The hash makes the sample, and with it every slice, a function of the rows alone, so a task that
runs again finds the same slices. Three things need to know what stands beyond a slice:

- places: running counts of the slices before;
- neighbours: a slice's first and last rows of all slices are one short sequence, in which the
  rows around a cut stand as they do in the whole;
- runs: what touches a slice's end is stitched in a second pass over at most two runs a slice.

Rows that agree in key and order have no order among them and cannot be cut apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.common import meet, settled

#: Rows of a slice, about; cuts of one level; sampled rows of a slice that is cut; levels at most.
ROWS, CUTS, SAMPLE, LEVELS = 1_000_000, 63, 8192, 8


def split(df: DataFrame, key: list[str], order: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the sequences of up to `rows` rows, and the others with their slice (`__slice`, ascending in the order); None if there are none."""
    rows = ROWS if rows is None else rows
    count = F.count(F.lit(1)).alias("__rows")
    long = settled(df.groupBy(*key).agg(count).where(F.col("__rows") > rows))
    if long.isEmpty():
        return df, None
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rest, hot = meet(df, long.drop("__rows"), key, "left_anti"), meet(df, long.drop("__rows"), key, "left_semi").withColumn("__slice", F.lit(0).cast("long"))
    at, groups = [*key, "__slice"], long.withColumn("__slice", F.lit(0).cast("long"))
    for _ in range(LEVELS):
        chosen = meet(hot, groups, at).where(F.pmod(F.xxhash64(*key, *order), F.ceil(F.col("__rows") / SAMPLE)) == 0)
        chosen = chosen.groupBy(*at).agg(F.array_sort(F.collect_set(place)).alias("__s"), F.max("__rows").alias("__rows"))
        cuts = F.least(F.lit(CUTS), F.ceil(2 * F.col("__rows") / rows))  # twice as many as needed, as quantiles of a sample are not exact
        picks = F.transform(F.sequence(F.lit(1), cuts), lambda i: F.get("__s", F.floor(i * F.size("__s") / (cuts + 1)).cast("int")))
        table = settled(chosen.select(*at, F.array_distinct(picks).alias("__cuts")))
        deeper = F.col("__slice") * (CUTS + 1) + F.coalesce(F.size(F.filter("__cuts", lambda c: c <= place)), F.lit(0))
        hot = meet(hot, table, at, "left").withColumn("__slice", deeper).drop("__cuts")
        before, groups = groups.agg(F.max("__rows")).first()[0], settled(hot.groupBy(*at).agg(count).where(F.col("__rows") > rows))
        if (most := groups.agg(F.max("__rows")).first()[0]) is None or most >= before:  # short enough, or all of one place in the order
            break
    return rest, hot


def _inside(key: list[str], order: list[str]) -> tuple[W, W]:
    w = W.partitionBy(*key).orderBy(*order)
    return w, w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _numbered(hot: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of slices with `__t` (place in the sequence), `__n` (rows of the sequence), `__first` and `__stop` (places of the slice)."""
    at = [*key, "__slice"]
    sizes = hot.groupBy(*at).agg(F.count(F.lit(1)).alias("__c"))
    w, whole = _inside(key, ["__slice"])
    first = F.coalesce(F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = settled(sizes.select(*at, first.alias("__first"), (first + F.col("__c")).alias("__stop"), F.sum("__c").over(whole).alias("__n")))
    inner = F.row_number().over(W.partitionBy(*at).orderBy(*order)) - 1
    return meet(hot.withColumn("__r", inner), sizes, at).withColumn("__t", F.col("__first") + F.col("__r")).drop("__r")


def placed(df: DataFrame, key: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """df with `__t`, the place of each row in its sequence from 0, and `__n`, the rows of the sequence."""
    rest, hot = split(df, key, order, rows)
    w, _ = _inside(key, order)
    out = rest.withColumns({"__t": (F.row_number().over(w) - 1).cast("long"), "__n": F.count(F.lit(1)).over(W.partitionBy(*key))})
    return out if hot is None else out.unionByName(_numbered(hot, key, order).select(*out.columns))


def neighbours(df: DataFrame, key: list[str], order: list[str], value: str, back: int, ahead: int, repeat: bool = True, rows: int | None = None) -> DataFrame:
    """df with `__b1`, `__b2`, ... and `__a1`, `__a2`, ...: value that many rows before and after; beyond the ends that of the end's row, or null."""
    rest, hot = split(df, key, order, rows)
    steps = [(f"__b{d}", F.lag, d) for d in range(1, back + 1)] + [(f"__a{d}", F.lead, d) for d in range(1, ahead + 1)]

    def around(key_: list[str]) -> dict[str, Column]:
        w, whole = _inside(key_, order)
        if not repeat:
            return {name: shift(value, d).over(w) for name, shift, d in steps}
        ends = {F.lag: F.first(value).over(whole), F.lead: F.last(value).over(whole)}
        return {name: F.when(shift(F.lit(1), d).over(w).isNull(), ends[shift]).otherwise(shift(value, d).over(w)) for name, shift, d in steps}

    out = rest.withColumns(around(key))
    if hot is None:
        return out
    at, reach = [*key, "__slice"], max(back, ahead)
    w, whole = _inside(at, order)
    inner = hot.withColumns({"__r": F.row_number().over(w) - 1, "__c": F.count(F.lit(1)).over(whole), **around(at)})
    left = F.col("__c") - 1 - F.col("__r")
    near = (F.col("__r") < reach) | (left < reach)
    across = around(key)  # over the rows near cuts only: at most twice the reach a slice
    room = {F.lag: F.col("__r"), F.lead: left}
    kept = {name: F.when(room[shift] >= d, F.col(name)).otherwise(F.col(f"{name}_")) for name, shift, d in steps}
    edges = inner.where(near).withColumns({f"{name}_": c for name, c in across.items()}).withColumns(kept)
    return reduce(DataFrame.unionByName, [x.select(*out.columns) for x in (inner.where(~near), edges)], out)


def _runs(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Runs of rows (key, `__t`, label)."""
    w = W.partitionBy(*key).orderBy("__t")
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag("__t").over(w).isNull()).cast("int")
    parts = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return parts.groupBy(*key, "__run").agg(F.first(label).alias(label), F.min("__t").alias("start"), (F.max("__t") + 1).alias("stop")).drop("__run")


def runs(df: DataFrame, key: list[str], order: list[str], label: str, rows: int | None = None) -> DataFrame:
    """key, label, start and stop (half open, by place) of the runs of equal labels; nulls are equal."""
    rest, hot = split(df.select(*key, *[c for c in order if c not in key], *[c for c in [label] if c not in [*key, *order]]), key, order, rows)
    w, _ = _inside(key, order)
    out = _runs(rest.withColumn("__t", (F.row_number().over(w) - 1).cast("long")), key, label)
    if hot is None:
        return out
    at = [*key, "__slice", "__first", "__stop"]
    parts = _runs(_numbered(hot, key, order), at, label)
    touches = (F.col("start") == F.col("__first")) | (F.col("stop") == F.col("__stop"))
    cut = W.partitionBy(*key).orderBy("start")  # at most two runs a slice
    new = (~F.col(label).eqNullSafe(F.lag(label).over(cut)) | ~F.col("start").eqNullSafe(F.lag("stop").over(cut))).cast("int")
    joined = parts.where(touches).withColumn("__new", new).withColumn("__run", F.sum("__new").over(cut))
    joined = joined.groupBy(*key, "__run").agg(F.first(label).alias(label), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return reduce(DataFrame.unionByName, [x.select(*out.columns) for x in (parts.where(~touches), joined)], out)
