"""Queries over training: CTC losses, the objective, gates, skipped utterances; and the SQL that checks them.

Fifty embeddings, neighbours by vec_id, are an utterance's frames, their components eight times
over its class scores. Documents are utterances of a hundred characters a second and three
characters a frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.arrays import total
from cadenza.operators import corpus, ctc, lifecycle, losses
from cadenza.operators import head_fit as head_fit_
from cadenza.plans import features

FRAMES, CLASSES = 50, 63


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / FRAMES).alias("utterance"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("logits"))
    return v.select("utterance", F.col("vec_id").alias("t"), losses.log_softmax(F.col("logits")).alias("log_probs"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 to 32 targets an utterance, equal ones side by side; every eleventh has more than its frames can hold, every thirteenth none."""
    u = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / FRAMES).alias("utterance")).distinct()
    n = F.when(F.col("utterance") % 11 == 10, 60).when(F.col("utterance") % 13 == 12, 0).otherwise(3 + F.col("utterance") % 30)
    each = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (1 + (F.col("utterance") * 7 + F.floor(i / 2) * 5) % CLASSES).cast("int"))
    return u.select("utterance", F.slice(each, F.lit(1), n.cast("int")).alias("targets"))


def ctc_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctc.losses(frames(spark, sf_dir), targets(spark, sf_dir), "utterance")
    return found.select("utterance", "frames", F.round("loss", 5).alias("loss"))


def finetune_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the CTC loss and two thirds of the score loss, by batch of four utterances; a word for each vector."""
    c = ctc.losses(frames(spark, sf_dir), targets(spark, sf_dir), "utterance").select(F.floor(F.col("utterance") / 4).alias("batch"), "loss")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = v.select(F.floor(F.col("vec_id") / (4 * FRAMES)).alias("batch"), losses.sigmoid(F.get("embedding", 0).cast("double")).alias("predicted"), (F.col("vec_id") % 11 / 10.0).alias("target"), (1 + F.col("vec_id") % 7).alias("weight"))
    found = ctc.objective(c, w, "batch", 0.25)
    return found.select("batch", *[F.round(x, 5).alias(x) for x in ("ctc_loss", "score_loss", "total")], "used")


def se_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of their label, scaled by a gate made of the mean over the kept ones (even vec_id), with weights by rule."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 2 == 0).alias("keep"))
    squeeze, excite = (lambda h, d: F.sin(h + 3 * d) / 4), (lambda d, h: F.cos(2 * d + h))
    gated = losses.squeeze_excite(v, ["label"], "v", "keep", 16, squeeze, excite)
    return gated.select("vec_id", F.round(total(F.col("gated")), 5).alias("total"))


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterances: every 23rd cannot be read, every 29th has no targets, the others one for two characters up to 1,500."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    count = F.when(F.col("doc_id") % 29 == 7, 0).otherwise(F.least(F.lit(1500), F.floor(F.col("n") / 2))).cast("int")
    labels = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: (F.floor(i / (F.col("doc_id") % 3 + 1)) % 41).cast("int"))).otherwise(F.array().cast("array<int>"))
    error = F.when(F.col("doc_id") % 23 == 5, F.concat(F.lit("cannot read "), F.col("doc_id").cast("string")))
    u = d.select("doc_id", F.floor(F.col("n") / 3).cast("int").alias("frames"), labels.alias("targets"), (F.col("n") / 100.0).alias("seconds"), error.alias("error"))
    reason = corpus.skip_reason(F.col("seconds"), F.col("frames"), F.col("targets"), F.lit(None).cast("string"), 60.0, F.col("error"))
    return u.withColumn("reason", reason)


def skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.skip_report(_skips(spark, sf_dir), "doc_id")


def skip_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.report_lines(corpus.skip_report(_skips(spark, sf_dir), "doc_id"))


def failed_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words scored and skipped where the labels 3 and 8 could not be read, and what is left of each label's scores."""
    failed = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label").isin(3, 8)).select("label")
    left, counts = corpus.evaluated(features.words(spark, sf_dir), features.frames(spark, sf_dir), failed, "label", features._classes(spark, sf_dir), features.METHODS)
    by = left.groupBy("label").agg(*[F.count(m).alias(m) for m in features.METHODS])
    return by.crossJoin(F.broadcast(counts))  # one row


def head_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the scoring head over the embeddings in two batches, from weights by rule."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    words = v.select("vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % 11 / 10.0).alias("target"), (1 + F.col("vec_id") % 3).alias("weight"))
    first = words.select(F.size("vector").alias("n")).first()
    dims = first["n"] if first else 1
    h, d = np.meshgrid(np.arange(8), np.arange(dims), indexing="ij")
    start = head_fit_.Head(np.sin(h + d) / 8, np.cos(np.arange(8)) / 8, np.cos(2 * np.arange(8)), 0.0)
    _, lines = head_fit_.fit(words.withColumn("part", F.floor(F.col("vec_id") / 16) % 2), start, 3, lambda t: 0.01 / (t + 1), "part", 2)
    return lines.select("step", "words", F.round("loss", 6).alias("loss"), "rate")


def epoch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders as epochs: mean order value as loss, and a rate that falls by month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    months = o.groupBy(((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).alias("epoch")).agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), (F.count(F.lit(1)) / 10.0).alias("seconds"))
    return lifecycle.epoch_lines(months.withColumn("rate", F.pow(F.lit(10.0), (F.col("epoch") % 9 - 6).cast("double")) * 3))


_FR = f"""v as (select vec_id, vec_id // {FRAMES} as u, list_transform(embedding, lambda x: 8 * x::double) as z from embeddings),
f as (select u, row_number() over (partition by u order by vec_id) - 1 as t, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) as p from v),
tg as (select u, case when u % 11 = 10 then 60 when u % 13 = 12 then 0 else 3 + u % 30 end as n from (select distinct u from v)),
lb as (select u, n, list_transform(range(0, 2 * n + 1), lambda s: case when s % 2 = 0 then 0 else 1 + (u * 7 + ((s // 2) // 2) * 5) % {CLASSES} end) as l from tg),
e as (select f.u, t, l, list_transform(l, lambda c: p[c + 1]) as e from f join lb using (u))"""
_ADD = """case when greatest(a[s], coalesce(a[s - 1], '-inf'::double), k[s]) = '-inf'::double then '-inf'::double else greatest(a[s], coalesce(a[s - 1], '-inf'::double), k[s])
  + ln(exp(a[s] - greatest(a[s], coalesce(a[s - 1], '-inf'::double), k[s])) + exp(coalesce(a[s - 1], '-inf'::double) - greatest(a[s], coalesce(a[s - 1], '-inf'::double), k[s])) + exp(k[s] - greatest(a[s], coalesce(a[s - 1], '-inf'::double), k[s]))) end"""
_CTC = f"""with recursive {_FR}, r as (select u, -1::bigint as t, list_transform(range(0, 2 * n + 1), lambda s: case when s = 0 then 0.0::double else '-inf'::double end) as a from lb
  union all select u, t, list_transform(range(1, len(l) + 1), lambda s: {_ADD} + e[s]) from (select r.u, e.t, e.e, e.l, r.a,
    list_transform(range(1, len(e.l) + 1), lambda s: case when s > 2 and e.l[s] <> 0 and e.l[s] <> e.l[s - 2] then r.a[s - 2] else '-inf'::double end) as k from r join e on e.u = r.u and e.t = r.t + 1)),
d as (select u, max(t) + 1 as frames, arg_max(a, t) as a from r group by u),
ls as (select u, frames, case when greatest(a[-1], coalesce(a[-2], '-inf'::double)) = '-inf'::double then 0.0::double
  else -(greatest(a[-1], coalesce(a[-2], '-inf'::double)) + ln(exp(a[-1] - greatest(a[-1], coalesce(a[-2], '-inf'::double))) + exp(coalesce(a[-2], '-inf'::double) - greatest(a[-1], coalesce(a[-2], '-inf'::double))))) end as loss from d)"""
_U = """u as (select doc_id, n_chars / 100.0::double as secs, n_chars // 3 as frames, case when doc_id % 29 = 7 then 0 else least(1500, n_chars // 2) end as n, doc_id % 3 + 1 as step from documents),
x as (select *, n + len(list_filter(range(2, n + 1), lambda i: (i // step) % 41 = ((i - 1) // step) % 41)) as needed,
  case when doc_id % 23 = 5 then 'failed' when secs < 0.5 then 'too_short' when secs > 60 then 'too_long' when n = 0 or frames < needed then 'too_few_frames' end as reason from u),
rp as (select count(*) filter (reason is null) as kept, count(*) filter (reason = 'too_short') as too_short, count(*) filter (reason = 'too_long') as too_long, count(*) filter (reason = 'too_few_frames') as too_few_frames,
  count(*) filter (reason = 'failed') as failed, 'cannot read ' || min(doc_id) filter (reason = 'failed') as first_error from x)"""
_GATE = """v as (select label, vec_id, embedding::double[] as v from embeddings), m as (select label, i, sum(case when vec_id % 2 = 0 then v[i + 1] else 0 end) / greatest(sum(case when vec_id % 2 = 0 then 1 else 0 end), 1) as m
  from v, (select unnest(range(0, (select max(len(v)) from v))) as i) group by label, i),
ml as (select label, list(m order by i) as m from m group by label),
h as (select label, list_transform(range(0, greatest(len(m) // 16, 1)), lambda h: greatest(0, list_sum(list_transform(range(0, len(m)), lambda d: m[d + 1] * sin(h + 3 * d) / 4)))) as h, len(m) as c from ml),
g as (select label, list_transform(range(0, c), lambda d: 1 / (1 + exp(-list_sum(list_transform(range(0, len(h)), lambda j: h[j + 1] * cos(2 * d + j)))))) as g from h)"""

QUERIES = {f.__name__: f for f in (ctc_loss, finetune_objective, se_gate, skip_report, skip_report_lines, failed_utterances, head_fit, epoch_lines)}
ORACLE = {
    "ctc_loss": f"{_CTC} select u as utterance, frames::integer as frames, round(loss, 5) as loss from ls",
    "finetune_objective": f"""{_CTC}, c as (select u // 4 as batch, avg(loss) as c from ls group by 1),
s as (select vec_id // {4 * FRAMES} as batch, avg((1 + vec_id % 7) * power(1 / (1 + exp(-embedding[1]::double)) - vec_id % 11 / 10.0::double, 2)) as s from embeddings group by 1)
select batch, round(c, 5) as ctc_loss, round(s, 5) as score_loss, round(c * 0.25::double + s * 0.75::double, 5) as total, true as used from c join s using (batch)""",
    "se_gate": f"with {_GATE} select vec_id, round(list_sum(list_transform(range(0, len(v)), lambda d: v[d + 1] * g[d + 1])), 5) as total from v join g using (label)",
    "skip_report": f"with {_U} select * from rp",
    "skip_report_lines": f"""with {_U} select 0 as ord, format('kept {{}} utterances; skipped {{}} too short, {{}} too long, {{}} with fewer frames than CTC targets, {{}} failed', kept, too_short, too_long, too_few_frames, failed) as line from rp
union all select 1, format('{{}} utterances failed to load, first error: {{}}', failed, first_error) from rp where failed > 0""",
    "epoch_lines": """with m as (select (year(o_orderdate) - 1990) * 12 + month(o_orderdate) as epoch, round(avg(o_totalprice), 4) as loss, count(*) / 10.0::double as seconds from orders group by 1)
select epoch::integer as epoch, format('epoch {}: loss {:.4f}, lr 3.00e{}, {:.1f}s', epoch, loss, epoch % 9 - 6, seconds) as line from m""",
    "failed_utterances": """with n as (select label, count(*) as n from embeddings group by label), w as (select label, p, (p + 1) * n // 5 > p * n // 5 and label not in (3, 8) as good from n, range(5) t(p)),
c as (select count(*) filter (good) as scored, count(*) filter (not good) as skipped from w)
select label, count(*) filter (good) as log_prob, count(*) filter (good) as max_logit, count(*) filter (good) as margin, count(*) filter (good) as self_aligned, any_value(c.scored) as scored, any_value(c.skipped) as skipped from w, c group by label""",
}
