"""Weights for unbalanced scores, losses and pair losses inside batches.

Pair losses compare the members of one batch; a batch's size is a parameter of the plan
(see batching), so pairs grow with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.arrays import once, total
from cadenza.operators.common import join_on

EDGES, BIN_CENTRES, RAW_EDGES = (0.2, 0.5, 0.7, 0.9), (0.1, 0.4, 0.65, 0.85, 1.0), (2, 5, 7, 9)
MAX_WEIGHT = 100.0


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(values: Column) -> Column:
    exponents = once(values, lambda vs: once(F.array_max(vs), lambda top: F.transform(vs, lambda v: F.exp(v - top))))
    return once(exponents, lambda e: once(total(e), lambda z: F.transform(e, lambda v: v / z)))


def log_sum_exp(values: Column) -> Column:
    return once(values, lambda vs: once(F.array_max(vs), lambda top: top + F.log(F.aggregate(vs, F.lit(0.0), lambda a, v: a + F.exp(v - top)))))


def log_softmax(values: Column) -> Column:
    return once(values, lambda vs: once(log_sum_exp(vs), lambda z: F.transform(vs, lambda v: v - z)))


def ordinal_bin(raw: Column) -> Column:
    return F.when(raw <= 2, 0).when(raw <= 5, 1).when(raw <= 7, 2).when(raw <= 9, 3).otherwise(4)


def inverse_frequency(counts: DataFrame, n: str, out: str = "weight") -> DataFrame:
    """Largest count over own count, at most 100. counts has one row per class."""
    return counts.withColumn(out, F.least(F.max(n).over(W.partitionBy()) / F.greatest(F.col(n), F.lit(1)), F.lit(MAX_WEIGHT)))


def effective_number(counts: DataFrame, n: str, beta: float, out: str = "weight") -> DataFrame:
    """Inverse effective number (1 - beta^n) / (1 - beta), at most 100, divided by its mean over classes."""
    size = F.col(n).cast("double") if beta <= 1.1920929e-07 else F.greatest(1 - F.pow(F.lit(beta), F.col(n)), F.lit(1e-6)) / (1 - beta)
    w = counts.withColumn("__w", F.least(1 / size, F.lit(MAX_WEIGHT))).withColumn("__m", F.avg("__w").over(W.partitionBy()))
    return w.withColumn(out, F.when(F.col("__m") > 1.1920929e-07, F.col("__w") / F.col("__m")).otherwise(F.col("__w"))).drop("__w", "__m")


def oversample(df: DataFrame, raw: str, below: int, factor: int) -> DataFrame:
    """Rows with a raw score under below as often as factor says."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(raw) < below, max(factor, 1)).otherwise(1))))


def weighted_mse(p: Column, y: Column, w: Column) -> Column:
    return F.avg(w * (p - y) * (p - y))


def focal_mse(p: Column, y: Column, w: Column, gamma: float) -> Column:
    e = p - y
    return F.avg(e * e * F.pow(F.least(F.abs(e), F.lit(1.0)), F.lit(gamma)) * w)


def _shift(k: int) -> float:
    import math

    return math.log(EDGES[k] / (1 - EDGES[k]))


def exceedance(logits: Column) -> list[Column]:
    """Probabilities that the score is over each edge."""
    return [sigmoid(F.get(logits, k) - _shift(k)) for k in range(4)]


def ordinal_score(logits: Column) -> Column:
    """Expected score of the threshold model: four logits."""
    p = [F.lit(1.0), *exceedance(logits), F.lit(0.0)]
    return sum(((p[k] - p[k + 1]) * BIN_CENTRES[k] for k in range(5)), F.lit(0.0))


def softmax_score(logits: Column) -> Column:
    """Expected score of the five-way model."""
    p = softmax(logits)
    return sum((F.get(p, k) * BIN_CENTRES[k] for k in range(5)), F.lit(0.0))


def ordinal_bce(logits: Column, raw: Column, w: Column) -> Column:
    """Mean over words and edges of the weighted binary cross-entropy, logarithms clamped at 1e-6."""
    def term(k: int, p: Column) -> Column:
        over = F.when(raw > RAW_EDGES[k], 1.0).otherwise(0.0)
        return -(over * F.log(F.greatest(p, F.lit(1e-6))) + (1 - over) * F.log(F.greatest(1 - p, F.lit(1e-6))))

    return F.avg(w * sum((term(k, p) for k, p in enumerate(exceedance(logits))), F.lit(0.0)) / 4)


def ordinal_ce(logits: Column, raw: Column, w: Column) -> Column:
    return F.avg(w * (log_sum_exp(logits) - F.get(logits, ordinal_bin(raw))))


def batch_pairs(df: DataFrame, batch: str, ident: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of different members of a batch: batch, a_<column>, b_<column>."""
    a = df.select(F.col(batch).alias("batch"), F.col(ident).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(F.col(batch).alias("__batch"), F.col(ident).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, (F.col("batch") == F.col("__batch")) & (F.col("a_id") != F.col("b_id"))).drop("__batch")


def pairwise_hinge(pairs: DataFrame, predicted: str, raw: str, margin: float) -> DataFrame:
    """Mean hinge over pairs whose first member has the higher raw score, by batch; 0 without such pairs."""
    higher = F.col(f"a_{raw}") > F.col(f"b_{raw}")
    hinge = F.greatest(F.lit(0.0), margin - (F.col(f"a_{predicted}") - F.col(f"b_{predicted}")))
    return pairs.groupBy("batch").agg(F.coalesce(F.avg(F.when(higher, hinge)), F.lit(0.0)).alias("loss"))


def balanced_mse(pairs: DataFrame, predicted: str, target: str, raw: str, sigma: float) -> DataFrame:
    """Negative log share of the softmax over a batch's targets that falls on targets of the own raw score.

    pairs must hold each member with itself too (see with_self).
    """
    near = F.exp(-F.pow(F.col(f"a_{predicted}") - F.col(f"b_{target}"), F.lit(2)) / (2 * sigma * sigma))
    own = pairs.groupBy("batch", "a_id").agg((F.sum(F.when(F.col(f"a_{raw}") == F.col(f"b_{raw}"), near).otherwise(0.0)) / F.sum(near)).alias("mass"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a_id") == F.col("b_id"), F.pow(F.col(f"a_{predicted}") - F.col(f"a_{target}"), F.lit(2)))).alias("square"))
    return own.groupBy("batch").agg(F.when(F.max("n") < 2, F.avg("square")).otherwise(-F.avg(F.log(F.greatest(F.col("mass"), F.lit(1e-6)))) * (2 * sigma * sigma)).alias("loss"))


def with_self(df: DataFrame, batch: str, ident: str, columns: list[str]) -> DataFrame:
    """batch_pairs and each member with itself."""
    own = df.select(F.col(batch).alias("batch"), F.col(ident).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in columns], F.col(ident).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return batch_pairs(df, batch, ident, columns).unionByName(own)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def triplet(pairs: DataFrame, vector: str, raw: str, margin: float) -> DataFrame:
    """Mean over anchors with both kinds of partners: max(0, mean distance to raw scores within 1 - mean to those 3 or more away + margin)."""
    gap, d = F.abs(F.col(f"a_{raw}") - F.col(f"b_{raw}")), squared_distance(F.col(f"a_{vector}"), F.col(f"b_{vector}"))
    anchors = pairs.groupBy("batch", "a_id").agg(F.avg(F.when(gap <= 1, d)).alias("near"), F.avg(F.when(gap >= 3, d)).alias("far"))
    return anchors.groupBy("batch").agg(F.coalesce(F.avg(F.when(F.col("near").isNotNull() & F.col("far").isNotNull(), F.greatest(F.lit(0.0), F.col("near") - F.col("far") + margin))), F.lit(0.0)).alias("loss"))


def rank_regularisation(pairs: DataFrame, unit: str, target: str, tau: float) -> DataFrame:
    """Mean squared gap between exp(-squared distance of unit vectors) and exp(-target gap / tau)."""
    a = F.exp(-squared_distance(F.col(f"a_{unit}"), F.col(f"b_{unit}")))
    b = F.exp(-F.abs(F.col(f"a_{target}") - F.col(f"b_{target}")) / max(tau, 1e-3))
    return pairs.groupBy("batch").agg(F.avg((a - b) * (a - b)).alias("loss"))


def unit_vector(v: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-6))
    return once(norm, lambda n: F.transform(v, lambda x: x / n))


def squeeze_excite(df: DataFrame, key: list[str], vector: str, keep: str, reduction: int, squeeze: Callable[[Column, Column], Column], excite: Callable[[Column, Column], Column], out: str = "gated") -> DataFrame:
    """Frames with their vector scaled by the gate of their key: mean over the kept frames (0 over none), a bottleneck of channels / reduction units with ReLU, sigmoid.

    squeeze(unit, channel) and excite(channel, unit) are the weights of the two layers, columns of the indices.
    """
    kept = F.when(F.col(keep), 1.0).otherwise(0.0)
    sums = df.select(*key, kept.alias("__kept"), F.posexplode(vector).alias("__d", "__x")).groupBy(*key, "__d").agg((F.sum(F.col("__x") * F.col("__kept")) / F.greatest(F.sum("__kept"), F.lit(1.0))).alias("__m"))
    means = sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__m"))), lambda x: x["__m"]).alias("__mean"))
    count = F.greatest(F.floor(F.size("__mean") / max(reduction, 1)).cast("int"), F.lit(1))
    hidden = F.transform(F.sequence(F.lit(0), count - 1), lambda h: F.greatest(F.lit(0.0), total(F.transform("__mean", lambda m, d: m * squeeze(h, d)))))
    gate = once(hidden, lambda hs: F.transform("__mean", lambda _, d: sigmoid(total(F.transform(hs, lambda x, h: x * excite(d, h))))))
    gates = means.select(*key, gate.alias("__gate"))
    return join_on(df, gates, key).withColumn(out, F.zip_with(vector, "__gate", lambda x, g: x * g)).drop("__gate")


def mixup(df: DataFrame, batch: str, ident: str, features: str, target: str, raw: str, weight: str, alpha: float, below: int, seed: int = 42) -> DataFrame:
    """Rows added for members with raw <= below: blended with another member of the batch by a hashed share in 0.5 +- alpha / 2."""
    w = W.partitionBy(batch)
    t = df.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy(ident)) - 1})
    u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(ident))), 1, 7), 16, 10).cast("long") / float(1 << 28)
    a = t.where((F.col(raw) <= below) & (F.col("__n") > 1)).withColumn("__j", (F.col("__i") + 1 + F.floor(u("p") * (F.col("__n") - 1))) % F.col("__n")).withColumn("__l", 0.5 + alpha * (u("l") - 0.5))
    b = t.select(F.col(batch).alias("__b"), F.col("__i").alias("__k"), *[F.col(c).alias(f"__{c}") for c in (features, target, raw, weight)])
    m = a.join(b, (F.col(batch) == F.col("__b")) & (F.col("__j") == F.col("__k")))
    blend = lambda c: F.col("__l") * F.col(c) + (1 - F.col("__l")) * F.col(f"__{c}")
    return m.select(batch, ident, F.zip_with(features, f"__{features}", lambda x, y: F.col("__l") * x + (1 - F.col("__l")) * y).alias(features), blend(target).alias(target), F.greatest(F.lit(0), F.least(F.lit(10), F.round(blend(raw)).cast("int"))).alias(raw), ((F.col(weight) + F.col(f"__{weight}")) / 2).alias(weight))
