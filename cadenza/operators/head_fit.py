"""Fitting the scoring head: an iterated fit whose gradient is summed on the executors.

The head is linear, ReLU, linear, sigmoid over a word's pooled vector; the loss is the mean weighted
squared error. The parameters and the optimiser's moments are one row of a table that is
written after each step; a step reads that row, sends it to the tasks (its size is the model's, not
the data's), each batch of words gives one vector of sums, and vectors are added in two rounds, by
FAN groups and then together. Words never leave their partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.common import settled

FAN = 32
# The optimiser's decay rates and guard.
DECAY, DECAY_SQUARES, GUARD = 0.9, 0.999, 1e-5


@dataclass
class Head:
    """hidden x dims weights and biases, hidden weights and a bias of the output."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.b, self.v, [self.c]])

    @staticmethod
    def of(flat: np.ndarray, dims: int, hidden: int) -> Head:
        k = dims * hidden
        return Head(flat[:k].reshape(hidden, dims), flat[k : k + hidden], flat[k + hidden : k + 2 * hidden], float(flat[-1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.maximum(x @ self.w.T + self.b, 0) @ self.v + self.c)))

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over words: the loss's gradient by parameter, the loss, the words."""
        z = x @ self.w.T + self.b
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ self.v + self.c)))
        out = 2 * weight * (p - y) * p * (1 - p)
        back = out[:, None] * self.v * (z > 0)
        return np.concatenate([(back.T @ x).ravel(), back.sum(axis=0), out @ h, [out.sum(), (weight * (p - y) ** 2).sum(), len(y)]])


def _sums(words: DataFrame, head: Head) -> np.ndarray:
    """Gradient, loss and count over all usable words."""
    shared = words.sparkSession.sparkContext.broadcast((head.flat(), *head.w.shape[::-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, dims, hidden = shared.value
        model = Head.of(flat, dims, hidden)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, dims)
                found = model.sums(x, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in part.column("sums").to_pylist()], axis=0)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = words.select("vector", "target", "weight").mapInArrow(run, "sums binary")
    for fan in (FAN, 1):
        parts = parts.withColumn("g", F.pmod(F.xxhash64("sums"), F.lit(fan))).groupBy("g").applyInArrow(add, "sums binary")
    rows = parts.collect()  # one row, as long as the parameters
    shared.unpersist()
    return np.frombuffer(rows[0]["sums"]) if rows else np.zeros(len(head.flat()) + 2)


def fit(words: DataFrame, start: Head, steps: int, rate: Callable[[int], float], batch: str | None = None, batches: int = 1) -> tuple[Head, DataFrame]:
    """The head after so many steps, and a table (step, words, loss before the step, rate).

    words: vector (array of doubles), target, weight, and, with batch, the number of the batch that a word is in: step t takes batch t modulo batches, else all words.
    Words with a null or a vector of another length take no part. A step without words or with a loss that is not finite changes nothing.
    """
    spark, (hidden, dims) = words.sparkSession, start.w.shape
    usable = words.where("vector IS NOT NULL AND target IS NOT NULL AND weight IS NOT NULL").where((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull()))
    usable = usable.select(F.col("vector").cast("array<double>"), F.col("target").cast("double"), F.col("weight").cast("double"), *([F.col(batch).alias("__batch")] if batch else []))
    n, lines = len(start.flat()), []
    schema = "steps int, parameters array<double>, first array<double>, second array<double>"
    state = settled(spark.createDataFrame([(0, start.flat().tolist(), [0.0] * n, [0.0] * n)], schema))
    for t in range(steps):
        row = state.first()
        taken, theta, m, v = row["steps"], *(np.array(row[c]) for c in ("parameters", "first", "second"))
        got = _sums(usable.where(F.col("__batch") == t % batches) if batch else usable, Head.of(theta, dims, hidden))
        count = got[-1]
        loss = got[-2] / count if count else float("nan")
        lines.append((t, int(count), float(loss), float(rate(t))))
        if np.isfinite(loss):
            g, taken = got[:n] / count, taken + 1
            m, v = DECAY * m + (1 - DECAY) * g, DECAY_SQUARES * v + (1 - DECAY_SQUARES) * g * g
            theta = theta - rate(t) * (m / (1 - DECAY**taken)) / (np.sqrt(v / (1 - DECAY_SQUARES**taken)) + GUARD)
            state = settled(spark.createDataFrame([(taken, theta.tolist(), m.tolist(), v.tolist())], schema))
    return Head.of(np.array(state.first()["parameters"]), dims, hidden), spark.createDataFrame(lines, "step int, words long, loss double, rate double")
