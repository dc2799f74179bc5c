"""Queries over acoustic features, scores and bookkeeping, and the SQL that checks them.

Embeddings are signals of 64 samples and, by label, per-frame class scores (vec_id is the
time); orders are training steps, their months epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import evaluate, features, lifecycle, losses, teacher
from cadenza.operators.common import settled
from cadenza.sources import text

METHODS = ["log_prob", "max_logit", "margin", "self_aligned"]
#: Embeddings, neighbours by vec_id, whose components one after the other are an utterance's samples.
UTTERANCE = 100


def hann_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hann_window(spark).select("n", F.round("w", 9).alias("w"))


def mel_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.mel_filterbank(spark, 40).select("filter", "bin", F.round("weight", 6).alias("weight"))


def dct_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dct_matrix(spark, 40).select("coef", "filter", F.round("weight", 6).alias("weight"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dft_power(_signals(spark, sf_dir), "vec_id", "x").select("vec_id", "bin", F.round("power", 6).alias("power"))


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = features.mel_filterbank(spark, 8, fft=64)
    return features.mel_energies(features.dft_power(_signals(spark, sf_dir), "vec_id", "x"), bank, "vec_id").select("vec_id", "filter", F.round("log_energy", 5).alias("log_energy"))


def mfcc_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = features.mel_filterbank(spark, 8, fft=64)
    energies = features.mel_energies(features.dft_power(_signals(spark, sf_dir), "vec_id", "x"), bank, "vec_id")
    return features.cepstra(energies, features.dct_matrix(spark, 8, 5), "vec_id").select("vec_id", "coef", F.round("value", 5).alias("value"))


def _acoustic(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    s = _signals(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / UTTERANCE).alias("utterance")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("s"))
    f = features.acoustic_frames(s.select("utterance", F.flatten(F.transform("s", lambda v: v["x"])).alias("samples")), mode, double=True)
    long = f.select("utterance", "feature_dim", F.posexplode("features").alias("i", "value"))
    return long.select("utterance", F.floor(F.col("i") / F.col("feature_dim")).alias("frame"), (F.col("i") % F.col("feature_dim")).alias("dim"), F.round("value", 5).alias("value"))


def mfcc39_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acoustic(spark, sf_dir, "mfcc39")


def logmel80_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _acoustic(spark, sf_dir, "logmel80")


def synthetic_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.synthetic_sample(spark, 8)
    return s.select("seed", "frames", F.concat_ws(" ", F.col("targets").cast("array<string>")).alias("targets"), F.round(F.aggregate("features", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, t, v, logits, log_probs: the components of each embedding as class scores."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("logits"))
    v = v.withColumn("t", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    return v.select("label", "t", "v", "logits", losses.log_softmax(F.col("logits")).alias("log_probs"))


def _classes(spark: SparkSession, sf_dir: str) -> int:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.size("embedding")).first()
    return row[0] if row else 0


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words for each label with the targets p + 1, p + 2, p + 1 and one that is no class."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("position")
    w = n.select("label", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position"))
    return w.select("label", "position", F.floor(p * F.col("n") / 5).alias("from"), F.floor((p + 1) * F.col("n") / 5).alias("to"), F.array(p + 1, p + 2, p + 1, F.lit(99)).alias("targets"))


def gop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluate.gop_scores(words(spark, sf_dir), frames(spark, sf_dir), "label", _classes(spark, sf_dir))
    return g.select("label", "position", *[F.round(c, 6).alias(c) for c in ("log_prob", "max_logit", "margin")])


def gop_self_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluate.gop_self_aligned(words(spark, sf_dir), frames(spark, sf_dir), "label", _classes(spark, sf_dir))
    return g.select("label", "position", F.round("self_aligned", 6).alias("self_aligned"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with each score and a human score by rule (words that were not scored count as such)."""
    w, f, n = words(spark, sf_dir), frames(spark, sf_dir), _classes(spark, sf_dir)
    g = evaluate.gop_scores(w, f, "label", n).withColumnsRenamed({"label": "l", "position": "p"})
    s = evaluate.gop_self_aligned(w, f, "label", n).withColumnsRenamed({"label": "l2", "position": "p2"})
    both = w.join(g, (F.col("label") == F.col("l")) & (F.col("position") == F.col("p")), "left").join(s, (F.col("label") == F.col("l2")) & (F.col("position") == F.col("p2")), "left")
    return both.withColumn("human", ((F.col("label") * 7 + F.col("position") * 3) % 11) / 10.0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(evaluate.tall(_both(spark, sf_dir), "label", METHODS, "human"))  # correlations and intervals read it several times


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each score with the human score."""
    r = evaluate.correlations(_scored(spark, sf_dir))
    return r.select("method", "n", F.round("rho", 6).alias("rho"), F.round("pearson", 6).alias("pearson"))


def evaluation_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluation_report with intervals over 2,000 resamples of the labels."""
    r = evaluate.report(_scored(spark, sf_dir), "label")
    return r.select("method", "n", *[F.round(c, 6).alias(c) for c in ("rho", "lo", "hi", "pearson")])


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that were scored and skipped; the fifth word of every third label has lost its targets."""
    b = _both(spark, sf_dir)
    lost = (F.col("label") % 3 == 0) & (F.col("position") == 4)
    return evaluate.word_counts(b.withColumns({m: F.when(~lost, F.col(m)) for m in METHODS}), METHODS)


def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.correlations(_scored(spark, sf_dir)).withColumn("rho", F.round("rho", 6))
    place = F.create_map(*[x for i, m in enumerate(METHODS) for x in (F.lit(m), F.lit(i))])
    return evaluate.best_method(r.withColumn("ord", place[F.col("method")]), "ord")


def evaluation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report as Markdown lines."""
    return evaluate.markdown(evaluation_intervals(spark, sf_dir), evaluate.word_counts(_both(spark, sf_dir), METHODS), facts={"Features": "embeddings"}).select("ord", "line")


def _head(v):  # noqa: ANN001, ANN202
    """Linear, ReLU, linear, sigmoid with weights by rule, as in the losses' queries."""
    dot = lambda h: F.aggregate(F.transform(v, lambda x, d: x * F.sin(d + F.lit(float(h))) / 8), F.lit(0.0), lambda a, b: a + b)
    hidden = F.array(*[F.greatest(F.lit(0.0), dot(h)) for h in range(8)])
    return losses.sigmoid(F.aggregate(F.transform(hidden, lambda x, h: x * F.cos(h.cast("double"))), F.lit(0.0), lambda a, b: a + b))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six words for each label, the last of them beyond its five."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct()
    w = n.select("label", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("position"), F.lit(5).alias("num_words"))
    return w.withColumn("human", ((F.col("label") * 7 + F.col("position") * 3) % 11) / 10.0)


def score_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from mean-pooled and from attention-pooled spans (attention: ten times the first component)."""
    w, f = _asked(spark, sf_dir), frames(spark, sf_dir)
    mean = evaluate.score_words(w, f, "label", _head).select("label", "position", F.round("score", 6).alias("score"))
    attention = evaluate.score_words(w, f, "label", _head, lambda v: F.get(v, 0) * 10).select(F.col("label").alias("l"), F.col("position").alias("p"), F.round("score", 6).alias("attention_score"))
    return mean.join(attention, (F.col("label") == F.col("l")) & (F.col("position") == F.col("p"))).select("label", "position", "score", "attention_score")


def _teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher frames: the vectors with an even vec_id of the labels not divisible by three."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where((F.col("vec_id") % 2 == 0) & (F.col("label") % 3 != 0))
    return v.select("label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), F.col("embedding").cast("array<double>").alias("v"))


def distillation_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each utterance (label) against teacher frames that are halved and shifted by a hundredth of the dimension."""
    project = lambda v: F.transform(v, lambda x, d: x * 0.5 + d * 0.01)
    d = teacher.distillation_loss(frames(spark, sf_dir).select("label", "t", "v"), _teacher(spark, sf_dir), "label", project)
    return d.select("label", "frames", F.round("loss", 6).alias("loss"))


def teacher_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the utterances that have teacher features."""
    return teacher.retained(_asked(spark, sf_dir), _teacher(spark, sf_dir), "label").select("label", "position")


def teacher_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, with the number of teacher frames of their utterance where there are any."""
    n = _teacher(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("teacher_frames"))
    return teacher.with_teacher(_asked(spark, sf_dir), n, "label").select("label", "position", "teacher_frames")


def teacher_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = teacher.evaluate_head(_asked(spark, sf_dir), _teacher(spark, sf_dir), "label", "human", _head)
    return r.select("n", F.round("rho", 6).alias("rho"), F.round("pearson", 6).alias("pearson"))


def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored words of a user's recording: valid ones by recording, in the order of their positions."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("audio_file"), F.concat(F.lit("text "), "event_type").alias("sentence_text"), (F.col("event_id") % 7).alias("word_position"), F.col("event_id").alias("ord"), (k / 90.0).alias("human_score"), (k % 11).alias("raw_score"))
    g = text.group_words(e.withColumn("valid", (F.col("word_position") < 6) & F.col("human_score").between(0, 1)))
    return g.select("audio_file", "sentence_text", F.size("words").alias("n"), F.md5(F.concat_ws(",", F.transform("words", lambda w: F.concat_ws(":", w["word_position"], w["ord"], w["raw_score"])))).alias("words_md5"))


def checkpoint_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of a run whose epochs are the orders' months: every sixth, the best so far, the final one."""
    e = lifecycle.step_mean_loss(_steps(spark, sf_dir), "epoch", "loss").select("epoch", F.round(-F.col("loss"), 3).alias("rho"))
    return lifecycle.checkpoints(e, "epoch", "rho", 6, 2)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    loss = F.when(F.col("o_orderkey") % 97 == 0, float("nan")).otherwise(F.col("o_totalprice") / 1000)
    return o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch"), loss.alias("loss"), (F.col("o_custkey") % 16 + 1).alias("samples"))


def epoch_loss_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.weighted_epoch_loss(_steps(spark, sf_dir), "epoch", "loss", "samples").select("epoch", F.round("loss", 5).alias("loss"), "skipped")


def epoch_loss_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.step_mean_loss(_steps(spark, sf_dir), "epoch", "loss").select("epoch", F.round("loss", 5).alias("loss"))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lifecycle.step_mean_loss(_steps(spark, sf_dir), "epoch", "loss").select("epoch", F.round(-F.col("loss"), 3).alias("rho"))
    return lifecycle.best_epoch(e, "epoch", "rho")


def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric lines: resumed from epoch 20, and from a checkpoint without an epoch in its name."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    lines = e.select(F.when(F.col("event_type") == "click", k).alias("epoch"), F.when(F.col("event_type") == "view", k).alias("epochs"), F.col("value").alias("elapsed_secs"))
    named = lifecycle.resume_state(lines, 20).select(F.lit("named").alias("kind"), "completed", "elapsed")
    return named.unionByName(lifecycle.resume_state(lines, None).select(F.lit("other").alias("kind"), "completed", "elapsed"))


_MEL = "select i, 700 * (power(10::double, (i::double / {n} * 2595 * log10(1 + 8000::double / 700)) / 2595) - 1) * {fft} / 16000 as l from range({n} + 1) t(i)"


def _bank(filters: int, fft: int) -> str:
    return f"""bank as (select i::integer as filter, k::integer as bin, case when k > l and k <= m then (k - l) / (m - l) else (r - k) / (r - m) end as weight
  from (select i, l, lead(l) over (order by i) as m, lead(l, 2) over (order by i) as r from ({_MEL.format(n=filters + 1, fft=fft)})), range({fft // 2 + 1}) b(k)
  where r is not null and k > l and k < r)"""


_PW = """sig as (select vec_id, unnest(range(64)) as t, unnest(embedding)::double as x from embeddings),
pw as (select vec_id, k::integer as bin, power(sum(x * cos(2 * pi() * (k * t % 64) / 64)), 2) + power(sum(x * sin(2 * pi() * (k * t % 64) / 64)), 2) as power from sig, range(33) b(k) group by vec_id, k)"""
_EN = "en as (select vec_id, filter, ln(sum(power * weight) + 1e-10::double) as e from pw join bank using (bin) group by vec_id, filter)"
_FR = """fr as (select label, row_number() over (partition by label order by vec_id) - 1 as t, list_transform(embedding, lambda x: x::double * 8) as lg from embeddings),
f as (select label, t, lg, list_transform(lg, lambda x: x - ln(list_sum(list_transform(lg, lambda y: exp(y))))) as lp from fr),
w as (select label, p as position, p * n // 5 as a, (p + 1) * n // 5 as b from (select label, count(*) as n from embeddings group by label), range(5) x(p)),
tg as (select *, unnest([position + 1, position + 2, position + 1]) as c, unnest([0, 1, 2]) as o from w)"""
_GOP = f"""g as (select label, position, o, max(lp[c + 1]) as x, max(lg[c + 1]) as y, max(lg[c + 1] - list_max(list_filter(lg, lambda z, i: i <> c + 1))) as z from tg join f using (label) where t >= a and t < b group by label, position, o),
gop as (select label, position, avg(x) as log_prob, avg(y) as max_logit, avg(z) as margin from g group by label, position)"""
_SA = """am as (select label, t, len(lp) - list_position(list_reverse(lp), list_max(lp)) as c from f),
ch as (select *, case when c = lag(c) over (partition by label order by t) then 0 else 1 end as fresh from am),
rn as (select *, sum(fresh) over (partition by label order by t) as run from ch),
sg as (select label, c, min(t) as s, max(t) + 1 as e from rn group by label, c, run having c <> 0),
hit as (select tg.label, position, o, tg.c, a, b, min(s) as s, arg_min(e, s) as e from tg left join sg on tg.label = sg.label and tg.c = sg.c and s < b and e > a group by all),
sc as (select hit.label, position, o, coalesce(avg(lp[c + 1]), -20) as v from hit left join f on hit.s is not null and f.label = hit.label and t >= greatest(a, s) and t < least(b, e) group by hit.label, position, o),
sa as (select label, position, avg(v) as self_aligned from sc group by label, position)"""
_BOTH = "b as (select w.label, w.position, (w.label * 7 + w.position * 3) % 11 / 10.0::double as human, log_prob, max_logit, margin, self_aligned from w left join gop using (label, position) left join sa using (label, position))"
_TALL = """tl as (select 'log_prob' as method, 0 as o, label, log_prob as p, human from b union all select 'max_logit', 1, label, max_logit, human from b union all select 'margin', 2, label, margin, human from b union all select 'self_aligned', 3, label, self_aligned, human from b),
ok as (select * from tl where p is not null)"""
_AC = f"""s as (select u, flatten(list(x order by vec_id)) as x from (select vec_id // {UTTERANCE} as u, vec_id, embedding::double[] as x from embeddings) group by u),
y as (select u, list_transform(range(1, len(x) + 1), lambda i: case when i = 1 then x[1] else x[i] - 0.97::double * x[i - 1] end) as y from s where len(x) >= 400),
af as (select u, y, unnest(range((len(y) - 400) // 160 + 1)) as frame from y),
sm as (select u, frame, t, y[frame * 160 + t + 1] * 0.5::double * (1 - cos(2 * pi() * t / 399)) as v from af, range(400) r(t)),
tr as (select k, cos(2 * pi() * k / 512) as c, sin(2 * pi() * k / 512) as s from range(512) r(k)),
apw as (select u, frame, b.k::integer as bin, power(sum(v * c), 2) + power(sum(v * tr.s), 2) as power from sm, range(257) b(k), tr where tr.k = (b.k * t) % 512 group by u, frame, b.k),
aen as (select u, frame, filter, ln(sum(power * weight) + 1e-10::double) as e from apw join bank using (bin) group by u, frame, filter)"""
_DELTA = "(coalesce(lead({x}, 1) over w, last_value({x}) over f) - coalesce(lag({x}, 1) over w, first_value({x}) over f) + 2 * (coalesce(lead({x}, 2) over w, last_value({x}) over f) - coalesce(lag({x}, 2) over w, first_value({x}) over f))) / 10"
_OVER = "window w as (partition by u, dim order by frame), f as (partition by u, dim order by frame rows between unbounded preceding and unbounded following)"
_MLP = """(1 / (1 + exp(-list_sum(list_transform(range(1, 9), lambda h: greatest(0, list_sum(list_transform(range(1, len({m}) + 1), lambda d: {m}[d] * sin(d - 1 + h - 1::double) / 8))) * cos(h - 1))))))"""
_TEACH = "te as (select label, row_number() over (partition by label order by vec_id) - 1 as t, embedding::double[] as v from embeddings where vec_id % 2 = 0 and label % 3 <> 0)"
_ASKED = "aw as (select label, p::integer as position, (label * 7 + p * 3) % 11 / 10.0::double as human from (select distinct label from embeddings), range(6) r(p))"


def _pool(source: str, weight: str) -> str:
    """pooled(label, position, m) over the spans of source(label, t, v)."""
    return f"""sp as (select aw.label, aw.position, aw.position * n // 5 as a, (aw.position + 1) * n // 5 as b from aw join (select label, count(*) as n from {source} group by label) c using (label) where aw.position < 5 and (aw.position + 1) * n // 5 > aw.position * n // 5),
fx as (select label, position, v, {weight} as e from sp join {source} x using (label) where t >= a and t < b),
px as (select label, position, d, sum(e * v[d + 1]) / sum(e) as x from fx, range((select max(len(embedding)) from embeddings)) r(d) group by label, position, d),
pooled as (select label, position, list(x order by d) as m from px group by label, position)"""


_STEPS = "st as (select year(o_orderdate) * 12 + month(o_orderdate) as epoch, case when o_orderkey % 97 = 0 then null else o_totalprice / 1000 end as loss, o_custkey % 16 + 1 as samples from orders)"
_RANK = "rank() over (partition by method order by {c}) + (count(*) over (partition by method, {c}) - 1) / 2.0::double"


def _corr(x: str, y: str, source: str, out: str) -> str:
    return f"select method, count(*) as n, round(sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)), 6) as {out} from (select method, {x} - avg({x}) over (partition by method) as dx, {y} - avg({y}) over (partition by method) as dy from {source}) group by method"


QUERIES = {
    f.__name__: f
    for f in (
        hann_window, mel_filterbank, dct_matrix, dft_power, log_mel, mfcc_static, mfcc39_frames, logmel80_frames, synthetic_samples, gop_scores, gop_self_aligned, evaluation_report, evaluation_intervals, evaluation_markdown, word_counts, best_method,
        score_words, distillation_mse, teacher_retained, teacher_words, teacher_head, word_groups, epoch_loss_weighted, epoch_loss_mean, best_epoch, checkpoint_policy, resume_state,
    )
}
ORACLE = {
    "hann_window": "select n::integer as n, round(0.5::double * (1 - cos(2 * pi() * n / 399)), 9) as w from range(400) t(n)",
    "mel_filterbank": f"with {_bank(40, 512)} select filter, bin, round(weight, 6) as weight from bank where weight > 0",
    "dct_matrix": "select c::integer as coef, j::integer as filter, round(cos(pi() * c * (j + 0.5::double) / 40), 6) as weight from range(13) a(c), range(40) b(j)",
    "dft_power": f"with {_PW} select vec_id, bin, round(power, 6) as power from pw",
    "log_mel": f"with {_PW}, {_bank(8, 64)}, {_EN} select vec_id, filter, round(e, 5) as log_energy from en",
    "mfcc_static": f"with {_PW}, {_bank(8, 64)}, {_EN} select vec_id, c::integer as coef, round(sum(e * cos(pi() * c * (filter + 0.5::double) / 8)), 5) as value from en, range(5) t(c) group by vec_id, c",
    "synthetic_samples": """with s as (select i as seed, (30 + 4 * i)::integer as frames, list_transform(range(6), lambda k: (i + k) % 40 + 1) as tg from range(8) t(i))
select seed, frames, array_to_string(tg, ' ') as targets, round(list_sum(flatten(list_transform(range(frames), lambda f: list_transform(range(13), lambda d: tg[f * 6 // frames + 1] * 0.05::double + d * 0.005::double + (f + d) % 7 * 0.01::double)))), 6) as total from s""",
    "gop_scores": f"with {_FR}, {_GOP} select label, position::integer as position, round(log_prob, 6) as log_prob, round(max_logit, 6) as max_logit, round(margin, 6) as margin from gop",
    "gop_self_aligned": f"with {_FR}, {_SA} select label, position::integer as position, round(self_aligned, 6) as self_aligned from sa",
    "mfcc39_frames": f"""with {_bank(40, 512)}, {_AC}, st as (select u, frame, c as dim, sum(e * cos(pi() * c * (filter + 0.5::double) / 40)) as x from aen, range(13) r(c) group by u, frame, c),
d1 as (select u, frame, dim, {_DELTA.format(x="x")} as x from st {_OVER}), d2 as (select u, frame, dim, {_DELTA.format(x="x")} as x from d1 {_OVER})
select u as utterance, frame, dim::integer as dim, round(x, 5) as value from (select * from st union all select u, frame, dim + 13, x from d1 union all select u, frame, dim + 26, x from d2)""",
    "logmel80_frames": f"with {_bank(80, 512)}, {_AC} select u as utterance, frame, filter as dim, round(e, 5) as value from aen",
    "word_counts": f"with {_FR}, {_GOP}, {_SA}, {_BOTH} select count(*) filter (where not (label % 3 = 0 and position = 4) and coalesce(log_prob, max_logit, margin, self_aligned) is not null) as scored, count(*) filter (where label % 3 = 0 and position = 4 or coalesce(log_prob, max_logit, margin, self_aligned) is null) as skipped from b",
    "best_method": f"""with {_FR}, {_GOP}, {_SA}, {_BOTH}, {_TALL}, rk as (select method, o, {_RANK.format(c="p")} as x, {_RANK.format(c="human")} as y from ok)
select method, rho from ({_corr("x", "y", "rk", "rho")}) join (select distinct method, o from ok) using (method) order by rho desc, o desc limit 1""",
    "score_words": f"""with {_ASKED}, fr as (select label, row_number() over (partition by label order by vec_id) - 1 as t, embedding::double[] as v from embeddings), {_pool("fr", "1")}, one as (select label, position, round({_MLP.format(m="m")}, 6) as score from pooled),
two as (with {_pool("fr", "exp(v[1] * 10)")} select label, position, round({_MLP.format(m="m")}, 6) as attention_score from pooled)
select label, position, score, attention_score from aw left join one using (label, position) left join two using (label, position)""",
    "distillation_mse": f"""with {_TEACH}, fr as (select label, row_number() over (partition by label order by vec_id) - 1 as t, embedding::double[] as v from embeddings), n as (select label, count(*) // 2 as n from fr group by label)
select fr.label, count(*) as frames, round(sum(list_sum(list_transform(range(1, len(fr.v) + 1), lambda d: power(fr.v[d] - te.v[d] * 0.5::double - (d - 1) * 0.01::double, 2)))) / sum(len(fr.v)), 6) as loss
from fr join n using (label) join te on te.label = fr.label and fr.t = 2 * te.t where te.t < n group by fr.label""",
    "teacher_retained": f"with {_TEACH}, {_ASKED} select label, position from aw where label in (select label from te)",
    "teacher_words": f"with {_TEACH}, {_ASKED} select aw.label, position, n as teacher_frames from aw left join (select label, count(*) as n from te group by label) using (label)",
    "teacher_head": f"""with {_TEACH}, {_ASKED}, {_pool("te", "1")}, ok as (select 'm' as method, {_MLP.format(m="m")} as p, human from pooled join aw using (label, position)), rk as (select method, {_RANK.format(c="p")} as x, {_RANK.format(c="human")} as y from ok)
select a.n, rho, pearson from ({_corr("x", "y", "rk", "rho")}) a join ({_corr("p", "human", "ok", "pearson")}) b on a.method = b.method""",
    "word_groups": """with e as (select user_id::varchar as audio_file, 'text ' || event_type as st, event_id % 7 as p, event_id as o, json_extract_string(props, '$.k')::integer as k from events)
select audio_file, arg_min(st, o) as sentence_text, count(*)::integer as n, md5(string_agg(p || ':' || o || ':' || (k % 11), ',' order by p, o)) as words_md5 from e where p < 6 and k / 90.0::double between 0 and 1 group by audio_file""",
    "checkpoint_policy": f"""with {_STEPS}, e as (select epoch, round(-avg(loss), 3) as rho from st group by epoch), x as (select *, case when epoch % 2 = 0 then rho end as seen, max(case when epoch % 2 = 0 then rho end) over (order by epoch rows between unbounded preceding and 1 preceding) as before from e),
c as (select epoch, rho, epoch % 6 = 0 as regular, coalesce(seen is not null and (before is null or seen > before), false) as best, epoch = max(epoch) over () as final from x) select * from c where regular or best or final""",
    "evaluation_intervals": f"""with {_FR}, {_GOP}, {_SA}, {_BOTH}, {_TALL}, c as (select method, label, row_number() over (partition by method order by label) - 1 as g, count(*) over (partition by method) as total from (select distinct method, label from ok)),
d as (select method, b, ('0x' || substr(md5('42:' || b || ':' || g), 1, 8))::bigint % total as g from c, range({evaluate.REPLICATES}) t(b)),
xy as (select d.method || ':' || d.b as mb, d.method, ok.p as x, ok.human as y from d join c on d.g = c.g and d.method = c.method join ok on ok.label = c.label and ok.method = c.method),
rb as (select mb, any_value(method) as method, case when count(*) < 2 or sqrt(sum(dx * dx) * sum(dy * dy)) < 1e-15 then 0 else sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) end as rho
  from (select mb, method, rx - avg(rx) over (partition by mb) as dx, ry - avg(ry) over (partition by mb) as dy from
    (select mb, method, rank() over (partition by mb order by x) + (count(*) over (partition by mb, x) - 1) / 2.0::double as rx, rank() over (partition by mb order by y) + (count(*) over (partition by mb, y) - 1) / 2.0::double as ry from xy)) group by mb),
ci as (select method, l[round(0.025 * n)::int + 1] as lo, l[round(0.975 * n)::int + 1] as hi from (select method, list_sort(list(rho)) as l, count(*) - 1 as n from rb group by method)),
rk as (select method, {_RANK.format(c="p")} as x, {_RANK.format(c="human")} as y from ok)
select a.method, a.n, rho, round(lo, 6) as lo, round(hi, 6) as hi, pearson from ({_corr("x", "y", "rk", "rho")}) a join ({_corr("p", "human", "ok", "pearson")}) b on a.method = b.method join ci on ci.method = a.method""",
    "evaluation_report": f"""with {_FR}, {_GOP}, {_SA}, {_BOTH}, {_TALL}, rk as (select method, {_RANK.format(c="p")} as x, {_RANK.format(c="human")} as y from ok)
select a.method, a.n, rho, pearson from ({_corr("x", "y", "rk", "rho")}) a join ({_corr("p", "human", "ok", "pearson")}) b on a.method = b.method""",
    "epoch_loss_weighted": f"with {_STEPS} select epoch, round(sum(loss * samples) / sum(samples) filter (where loss is not null), 5) as loss, count(*) filter (where loss is null) as skipped from st group by epoch",
    "epoch_loss_mean": f"with {_STEPS} select epoch, round(avg(loss), 5) as loss from st group by epoch",
    "best_epoch": f"with {_STEPS}, e as (select epoch, round(-avg(loss), 3) as rho from st group by epoch) select epoch, rho from e order by rho desc, epoch limit 1",
    "resume_state": """with l as (select case when event_type in ('click', 'view') then json_extract_string(props, '$.k')::int end as e, value from events)
select 'named' as kind, 20 as completed, coalesce(max(value) filter (where e is null or e <= 20), 0) as elapsed from l
union all select 'other', coalesce(max(e), 0), coalesce(max(value), 0) from l""",
}
_NAMES = ", ".join(f"('{m}', '{name}', '{said}', {200 + i})" for i, (m, (name, said)) in enumerate(evaluate.METHODS.items()))
ORACLE["evaluation_markdown"] = f"""with {_FR}, {_GOP}, {_SA}, {_BOTH}, ci as ({ORACLE["evaluation_intervals"]}),
c as (select count(*) filter (where x) as scored, count(*) filter (where not x) as skipped from (select coalesce(log_prob, max_logit, margin, self_aligned) is not null as x from b))
select 0 as ord, '# Evaluation' as line union all select 1, '' union all select 2, '- Features: embeddings' union all select 100, printf('- Words: %d scored, %d skipped', scored, skipped) from c
union all select 101, '' union all select 102, '| Method | Words | Spearman ρ | 95% CI | Pearson | Description |' union all select 103, '|---|---|---|---|---|---|'
union all select o, printf('| %s | %d | %.4f | [%.4f, %.4f] | %.4f | %s |', name, n, rho, lo, hi, pearson, said) from ci join (values {_NAMES}) m(method, name, said, o) using (method)"""
