"""Operators on sequences: lags, deltas, frames, runs, spans, alignment of segments.

A sequence is a key (an utterance, a user) and an order. Short sequences are windows of their
key; long ones are cut into slices (operators/slices.py), so that no task holds a whole one.
Spans meet frames and segments through bins (operators/intervals.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import intervals, slices


def pre_emphasis(df: DataFrame, key: list[str], order: list[str], value: str, out: str, factor: float = 0.97) -> DataFrame:
    """value minus factor times the one before; the first stays."""
    near = slices.neighbours(df, key, order, value, 1, 0, repeat=False)
    return near.withColumn(out, F.coalesce(F.col(value) - factor * F.col("__b1"), F.col(value))).drop("__b1")


def regression_delta(df: DataFrame, key: list[str], order: list[str], value: str, out: str, reach: int = 2) -> DataFrame:
    """Regression slope over +-reach steps, edges repeated; null where a row it takes is null."""
    near = slices.neighbours(df, key, order, value, reach, reach)
    total = sum((d * (F.col(f"__a{d}") - F.col(f"__b{d}")) for d in range(1, reach + 1)), F.lit(0.0))
    return near.withColumn(out, total / (2.0 * sum(d * d for d in range(1, reach + 1)))).drop(*[f"__{s}{d}" for s in "ab" for d in range(1, reach + 1)])


def hopping_frames(signal: Column, length: int, hop: int) -> Column:
    """Overlapping frames of an array; the tail that fills no frame is dropped, a short signal has none."""
    n = F.floor((F.size(signal) - length) / hop).cast("int")
    return F.when(F.size(signal) >= length, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(signal, i * hop + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def framed(df: DataFrame, key: list[str], order: list[str], value: str, length: int, hop: int) -> DataFrame:
    """key, frame, t, value: the rows of each whole frame, t from 0 inside it. A sequence is never one row."""
    place = slices.placed(df, key, order).where(F.col("__n") >= length)
    first = F.greatest(F.lit(0), F.ceil((F.col("__t") - (length - 1)) / hop)).cast("int")
    last = F.least(F.floor(F.col("__t") / hop), F.floor((F.col("__n") - length) / hop)).cast("int")
    rows = place.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.select(*key, "frame", (F.col("__t") - F.col("frame") * hop).cast("int").alias("t"), value)


def ctc_frames_needed(df: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """key, targets, min_frames of sequences of labels that are rows: one frame each, and a blank between equal neighbours."""
    long = slices.runs(df, key, order, label).groupBy(*key).agg(F.sum(F.col("stop") - F.col("start")).alias("targets"), F.count(F.lit(1)).alias("__runs"))
    return long.select(*key, "targets", (2 * F.col("targets") - F.col("__runs")).alias("min_frames"))


def ctc_min_frames(targets: Column) -> Column:
    """Frames that an alignment of the targets needs: one each, and a blank between equal neighbours."""
    repeats = F.filter(F.transform(targets, lambda x, i: (i > 0) & (x == F.get(targets, i - 1))), lambda same: same)
    return F.size(targets) + F.size(repeats)


def ctc_feasible(targets: Column, frames: Column) -> Column:
    return (F.size(targets) > 0) & (frames >= ctc_min_frames(targets))


def runs(df: DataFrame, key: list[str], order: list[str], label: str, blank: object | None = None) -> DataFrame:
    """Runs of equal labels: key, label, start and stop (half open, by place), blank runs left out."""
    out = slices.runs(df, key, order, label)
    return out.where(F.col(label) != F.lit(blank)) if blank is not None else out


def frame_argmax(scores: Column) -> Column:
    """Index from 0 of the largest score; of equal ones the last."""
    return F.array_max(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def greedy_path(frames: DataFrame, key: list[str], order: list[str], log_probs: str, blank: int = 0) -> DataFrame:
    """Greedy CTC segments: best class per frame, runs merged, blanks dropped."""
    return runs(frames.withColumn("class", frame_argmax(F.col(log_probs))), key, order, "class", blank)


def word_span(position: Column, words: Column, frames: Column) -> Column:
    """Proportional share of the frames as struct(start, stop); null where there is none."""
    pos, n = position.cast("long"), words.cast("long")
    whole = lambda x: F.call_function("div", x, F.nullif(n, F.lit(0)))
    start, stop = whole(pos * frames), whole((pos + 1) * frames)
    return F.when((frames > 0) & (n > 0) & (pos < n) & (stop > start), F.struct(start.alias("start"), stop.alias("stop")))


def first_overlapping(targets: DataFrame, segments: DataFrame, key: list[str], label: str) -> DataFrame:
    """targets(key, label, from, to, ...) with seg_start and seg_stop of the first segment of that label that overlaps; null if none."""
    s = segments.select(*key, label, F.col("start").alias("__s"), F.col("stop").alias("__e"))
    pairs = intervals.overlapping(targets, s, [*key, label], ("from", "to"), ("__s", "__e"), "left")
    best = pairs.groupBy(*targets.columns).agg(F.min(F.when(F.col("__s").isNotNull(), F.struct("__s", "__e"))).alias("__best"))
    return best.select(*targets.columns, F.col("__best.__s").alias("seg_start"), F.col("__best.__e").alias("seg_stop"))
