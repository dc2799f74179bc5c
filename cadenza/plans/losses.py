"""Queries over weights and losses, and the SQL that checks them.

An event is a scored word: k modulo 11 is the raw score, k / 100 the human score, value / 500
the predicted one. Embeddings are words with pooled features: vec_id modulo 11 is the raw
score; batches hold 16 neighbours by vec_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import losses
from cadenza.plans.stats import EV, events


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "event_type", F.floor(F.col("event_id") / 16).alias("batch"), (F.col("k") % 11).cast("int").alias("raw"), (F.col("k") / 100.0).alias("y"), (F.col("value") / 500.0).alias("p"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return v.withColumns({"batch": F.floor(F.col("vec_id") / 16), "raw": (F.col("vec_id") % 11).cast("int"), "y": F.col("vec_id") % 11 / 10.0})


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.inverse_frequency(_counts(spark, sf_dir), "n").select("raw", "n", F.round("weight", 6).alias("weight"))


def effective_number_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.effective_number(_counts(spark, sf_dir), "n", 0.999).select("raw", "n", F.round("weight", 6).alias("weight"))


def oversample_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.oversample(words(spark, sf_dir), "raw", 3, 3).select("event_id", "raw", "copy")


def reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-frequency weight of every word's ordinal bin: the weights are five rows at most."""
    w = words(spark, sf_dir).withColumn("bin", losses.ordinal_bin(F.col("raw")))
    weights = losses.inverse_frequency(w.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), "n")
    return w.join(F.broadcast(weights), "bin").select("event_id", "bin", F.round("weight", 6).alias("weight"))


def ordinal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy(losses.ordinal_bin(F.col("raw")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def weighted_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return w.groupBy("event_type").agg(F.round(losses.weighted_mse(F.col("p"), F.col("y"), 1 + F.col("raw") / 10), 6).alias("loss"))


def focal_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    return w.groupBy("event_type").agg(F.round(losses.focal_mse(F.col("p"), F.col("y"), 1 + F.col("raw") / 10, 2.0), 6).alias("loss"))


def _logits(n: int) -> Column:
    """n logits from all components: the k-th is the sum of components k, k + n, k + 2n, ..."""
    return F.array(*[F.aggregate(F.filter("v", lambda _, d: d % n == k), F.lit(0.0), lambda s, x: s + x) for k in range(n)])


def ordinal_expected_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", _logits(4).alias("l4"), _logits(5).alias("l5"))
    return v.select("vec_id", F.round(losses.ordinal_score(F.col("l4")), 6).alias("threshold_score"), F.round(losses.softmax_score(F.col("l5")), 6).alias("softmax_score"))


def ordinal_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("label", "raw", _logits(4).alias("l4"), _logits(5).alias("l5"), (1 + F.col("raw") / 10).alias("w"))
    return v.groupBy("label").agg(F.round(losses.ordinal_bce(F.col("l4"), F.col("raw"), F.col("w")), 6).alias("bce"), F.round(losses.ordinal_ce(F.col("l5"), F.col("raw"), F.col("w")), 6).alias("ce"))


def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(losses.log_sum_exp(F.col("v")), 6).alias("lse"))


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors(spark, sf_dir).select("vec_id", losses.softmax(F.col("v")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s - x * F.log(x)), 6).alias("entropy"))


def pairwise_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = losses.batch_pairs(words(spark, sf_dir), "batch", "event_id", ["p", "raw"])
    return losses.pairwise_hinge(pairs, "p", "raw", 0.1).select("batch", F.round("loss", 9).alias("loss"))


def balanced_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = losses.with_self(words(spark, sf_dir), "batch", "event_id", ["p", "y", "raw"])
    return losses.balanced_mse(pairs, "p", "y", "raw", 0.5).select("batch", F.round("loss", 6).alias("loss"))


def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = losses.batch_pairs(vectors(spark, sf_dir), "batch", "vec_id", ["v", "raw"])
    return losses.triplet(pairs, "v", "raw", 0.2).select("batch", F.round("loss", 6).alias("loss"))


def rank_regularization(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("u", losses.unit_vector(F.col("v")))
    pairs = losses.batch_pairs(v, "batch", "vec_id", ["u", "y"])
    return losses.rank_regularisation(pairs, "u", "y", 0.3).select("batch", F.round("loss", 6).alias("loss"))


def mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("w", 1 + F.col("raw") / 10)
    m = losses.mixup(v, "batch", "vec_id", "v", "y", "raw", "w", 0.4, 4)
    return m.select("batch", "vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round("y", 9).alias("y"), "raw", F.round("w", 6).alias("w"))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm-up of three epochs, then half a cosine: twenty epochs at 3e-4."""
    e, base, total, warm = F.col("id"), 3e-4, 20, 3
    rate = F.when(e < warm, base * (e + 1) / warm).otherwise(base / 2 * (1 + F.cos(F.lit(3.141592653589793) * (e - warm) / max(total - warm, 1))))
    return spark.range(total).select(e.alias("epoch"), F.round(rate, 9).alias("rate"))


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("dim", "x"))
    return v.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"))


def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a label weighted by the softmax of ten times their first component."""
    v = vectors(spark, sf_dir).select("label", (F.get("v", 0) * 10).alias("s"), "v")
    top = v.groupBy("label").agg(F.max("s").alias("m")).withColumnRenamed("label", "l")
    w = v.join(top, F.col("label") == F.col("l")).select("label", F.exp(F.col("s") - F.col("m")).alias("e"), F.posexplode("v").alias("dim", "x"))
    return w.groupBy("label", "dim").agg(F.round(F.sum(F.col("e") * F.col("x")) / F.sum("e"), 6).alias("pooled"))


def se_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the kept frames (purchases) of each user, 0 over none."""
    keep = F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum(F.col("value") * keep) / F.greatest(F.sum(keep), F.lit(1.0)), 6).alias("mean"))


def mlp_head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear, ReLU, linear, sigmoid with weights by rule: hidden unit h of eight weighs dimension d by sin(h + d) / 8."""
    dot = lambda h: F.aggregate(F.transform("v", lambda x, d: x * F.sin(d + F.lit(float(h))) / 8), F.lit(0.0), lambda a, b: a + b)
    hidden = F.array(*[F.greatest(F.lit(0.0), dot(h)) for h in range(8)])
    out = F.aggregate(F.transform(hidden, lambda x, h: x * F.cos(h.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    return vectors(spark, sf_dir).select("vec_id", F.round(losses.sigmoid(out), 6).alias("score"))


_WORDS = f"{EV}, w as (select event_id, event_type, event_id // 16 as batch, (k % 11)::integer as raw, k / 100.0::double as y, value / 500.0::double as p from ev)"
_VEC = "v as (select vec_id, label, embedding::double[] as v, vec_id // 16 as batch, (vec_id % 11)::integer as raw, vec_id % 11 / 10.0::double as y from embeddings)"
_BIN = "case when raw <= 2 then 0 when raw <= 5 then 1 when raw <= 7 then 2 when raw <= 9 then 3 else 4 end"
_SQ = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
_EDGE = {k: f"ln({t}::double / (1 - {t}::double))" for k, t in enumerate((0.2, 0.5, 0.7, 0.9))}
_FOLD = lambda n: f"list_transform(range({n}), lambda k: list_sum(list_transform(range(k, len(v), {n}), lambda d: v[d + 1])))"
_LG = f"{_VEC}, lg as (select *, {_FOLD(4)} as l4, {_FOLD(5)} as l5 from v)"
_P = {k: f"(1 / (1 + exp(-(l4[{k + 1}] - {_EDGE[k]}))))" for k in range(4)}
_SM = [f"exp(l5[{k}])" for k in range(1, 6)]
_CE = f"(ln({' + '.join(_SM)}) - l5[{_BIN} + 1])"
_U = lambda salt: f"('0x' || substr(md5('42{salt}:' || a.vec_id), 1, 7))::bigint / 268435456.0::double"

QUERIES = {
    f.__name__: f
    for f in (inverse_frequency_weights, effective_number_weights, oversample_low, reweight, ordinal_bins, weighted_mse, focal_mse, ordinal_expected_score, ordinal_losses, log_sum_exp, softmax_rows, pairwise_hinge, balanced_mse, triplet_loss, rank_regularization, mixup, lr_schedule, mean_pool, attention_pool, se_masked_mean, mlp_head_scores)
}
ORACLE = {
    "inverse_frequency_weights": f"with {_WORDS}, c as (select raw, count(*) as n from w group by raw) select raw, n, round(least(max(n) over () / greatest(n, 1)::double, 100), 6) as weight from c",
    "effective_number_weights": f"""with {_WORDS}, c as (select raw, count(*) as n from w group by raw), e as (select raw, n, least(1 / (greatest(1 - power(0.999::double, n), 1e-6) / (1 - 0.999::double)), 100) as x from c)
select raw, n, round(x / avg(x) over (), 6) as weight from e""",
    "oversample_low": f"with {_WORDS} select event_id, raw, unnest(range(1, case when raw < 3 then 4 else 2 end))::integer as copy from w",
    "reweight": f"with {_WORDS}, b as (select event_id, {_BIN} as bin from w), c as (select bin, least(max(count(*)) over () / greatest(count(*), 1)::double, 100) as weight from b group by bin) select event_id, bin, round(weight, 6) as weight from b join c using (bin)",
    "ordinal_bins": f"with {_WORDS} select {_BIN} as bin, count(*) as n from w group by 1",
    "weighted_mse": f"with {_WORDS} select event_type, round(avg((1 + raw / 10.0::double) * (p - y) * (p - y)), 6) as loss from w group by event_type",
    "focal_mse": f"with {_WORDS} select event_type, round(avg((p - y) * (p - y) * power(least(abs(p - y), 1), 2) * (1 + raw / 10.0::double)), 6) as loss from w group by event_type",
    "ordinal_expected_score": f"""with {_LG} select vec_id, round(0.1::double * (1 - {_P[0]}) + 0.4::double * ({_P[0]} - {_P[1]}) + 0.65::double * ({_P[1]} - {_P[2]}) + 0.85::double * ({_P[2]} - {_P[3]}) + {_P[3]}, 6) as threshold_score,
round((0.1::double * {_SM[0]} + 0.4::double * {_SM[1]} + 0.65::double * {_SM[2]} + 0.85::double * {_SM[3]} + {_SM[4]}) / ({' + '.join(_SM)}), 6) as softmax_score from lg""",
    "ordinal_losses": f"""with {_LG} select label, round(avg((1 + raw / 10.0::double) * ({' + '.join(f'-(case when raw > {e} then ln(greatest({_P[k]}, 1e-6)) else ln(greatest(1 - {_P[k]}, 1e-6)) end)' for k, e in enumerate((2, 5, 7, 9)))}) / 4), 6) as bce,
round(avg((1 + raw / 10.0::double) * {_CE}), 6) as ce from lg group by label""",
    "log_sum_exp": f"with {_VEC} select vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) as lse from v",
    "softmax_rows": f"with {_VEC} select vec_id, round(exp(list_max(v)) / list_sum(list_transform(v, lambda x: exp(x))), 6) as top, round(ln(list_sum(list_transform(v, lambda x: exp(x)))) - list_sum(list_transform(v, lambda x: x * exp(x))) / list_sum(list_transform(v, lambda x: exp(x))), 6) as entropy from v",
    "pairwise_hinge": f"with {_WORDS} select a.batch, round(coalesce(avg(case when a.raw > b.raw then greatest(0, 0.1::double - (a.p - b.p)) end), 0), 9) as loss from w a join w b on a.batch = b.batch and a.event_id <> b.event_id group by a.batch",
    "balanced_mse": f"""with {_WORDS}, m as (select a.batch, a.event_id, sum(case when a.raw = b.raw then exp(-power(a.p - b.y, 2) / 0.5::double) else 0 end) / sum(exp(-power(a.p - b.y, 2) / 0.5::double)) as mass, count(*) as n, any_value((a.p - a.y) * (a.p - a.y)) as sq
from w a join w b on a.batch = b.batch group by a.batch, a.event_id)
select batch, round(case when max(n) < 2 then avg(sq) else -avg(ln(greatest(mass, 1e-6))) * 0.5::double end, 6) as loss from m group by batch""",
    "triplet_loss": f"""with {_VEC}, d as (select a.batch, a.vec_id, avg(case when abs(a.raw - b.raw) <= 1 then {_SQ} end) as near, avg(case when abs(a.raw - b.raw) >= 3 then {_SQ} end) as far
from v a join v b on a.batch = b.batch and a.vec_id <> b.vec_id group by a.batch, a.vec_id)
select batch, round(coalesce(avg(case when near is not null and far is not null then greatest(0, near - far + 0.2::double) end), 0), 6) as loss from d group by batch""",
    "rank_regularization": f"""with {_VEC}, u as (select vec_id, batch, y, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda z: z * z))), 1e-6)) as v from v)
select a.batch, round(avg(power(exp(-{_SQ}) - exp(-abs(a.y - b.y) / 0.3::double), 2)), 6) as loss from u a join u b on a.batch = b.batch and a.vec_id <> b.vec_id group by a.batch""",
    "mixup": f"""with {_VEC}, t as (select *, 1 + raw / 10.0::double as w, count(*) over (partition by batch) as n, row_number() over (partition by batch order by vec_id) - 1 as i from v),
a as (select *, (i + 1 + floor({_U("p")} * (n - 1))::bigint) % n as j, 0.5::double + 0.4::double * ({_U("l")} - 0.5::double) as l from t a where raw <= 4 and n > 1)
select a.batch, a.vec_id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda d: a.l * a.v[d] + (1 - a.l) * b.v[d])), 6) as total, round(a.l * a.y + (1 - a.l) * b.y, 9) as y,
  greatest(0, least(10, round(a.l * a.raw + (1 - a.l) * b.raw)::integer)) as raw, round((a.w + b.w) / 2, 6) as w from a join t b on a.batch = b.batch and a.j = b.i""",
    "lr_schedule": "select e as epoch, round(case when e < 3 then 0.0003::double * (e + 1) / 3 else 0.00015::double * (1 + cos(3.141592653589793::double * (e - 3) / 17)) end, 9) as rate from range(20) t(e)",
    "mean_pool": f"with {_VEC}, x as (select label, unnest(range(len(v)))::integer as dim, unnest(v) as x from v) select label, dim, round(avg(x), 6) as mean from x group by label, dim",
    "attention_pool": f"""with {_VEC}, s as (select label, v, exp(10 * v[1] - max(10 * v[1]) over (partition by label)) as e from v), x as (select label, e, unnest(range(len(v)))::integer as dim, unnest(v) as x from s)
select label, dim, round(sum(e * x) / sum(e), 6) as pooled from x group by label, dim""",
    "se_masked_mean": f"with {EV} select user_id, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0) / greatest(count(*) filter (where event_type = 'purchase'), 1), 6) as mean from ev group by user_id",
    "mlp_head_scores": f"""with {_VEC}, h as (select vec_id, list_transform(range(8), lambda h: greatest(0, list_sum(list_transform(range(1, len(v) + 1), lambda d: v[d] * sin(d - 1 + h::double) / 8)))) as z from v)
select vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(1, 9), lambda h: z[h] * cos(h - 1))))), 6) as score from h""",
}
