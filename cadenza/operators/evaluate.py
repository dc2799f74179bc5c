"""Pronunciation scores from per-frame class scores, and the report over them.

Frames are rows (key, t, log_probs, logits); words are rows (key, position, from, to,
targets). Words meet their frames through bins of places (operators/intervals.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import intervals, sequence, stats
from cadenza.operators.common import join_on

DELETED = -20.0
REPLICATES = 2000
LEAST_SCORED = 10
# Names and descriptions of the methods in a report.
METHODS = {
    "log_prob": ("GOP-LogProb", "mean over phonemes of the max log-probability in the word"), "max_logit": ("GOP-MaxLogit", "same with raw logits"),
    "margin": ("GOP-Margin", "target logit minus the best other logit (blank included)"), "self_aligned": ("GOP-SA", "log-probability over the CTC best-path segment"),
    "head": ("ScoringHead", "fine-tuned scoring head"),
}


def at_least(n: Column, least: int, what: str) -> Column:
    """n, or an error if it is less."""
    return F.when(n >= least, n).otherwise(F.raise_error(F.concat(F.lit("only "), n.cast("string"), F.lit(f" {what}; need at least {least}"))).cast("long"))


def never_empty(df: DataFrame, message: str) -> DataFrame:
    """df; an error right away if it has no rows."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def word_targets(words: DataFrame, classes: int) -> DataFrame:
    """One row per target of a word; targets that are no class are left out. ord tells repeated ones apart."""
    kept = F.filter("targets", lambda c: c.isNotNull() & (c >= 0) & (c < classes))
    return words.withColumn("targets", kept).select(*[c for c in words.columns if c != "targets"], F.posexplode("targets").alias("ord", "class"))


def _frames_of(words: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    return intervals.points_in(words, frames, [key], "from", "to", "t")


def gop_scores(words: DataFrame, frames: DataFrame, key: str, classes: int) -> DataFrame:
    """key, position, log_prob, max_logit, margin: best value over the word's frames for each target, mean over targets.

    The margin is to the best other class, the blank included.
    """
    best_class = F.array_position("logits", F.array_max("logits")).cast("int") - 1
    ranked = frames.select(key, "t", "log_probs", "logits", best_class.alias("__k"), F.array_max("logits").cast("double").alias("__max"))
    ranked = ranked.withColumn("__next", F.coalesce(F.array_max(F.filter("logits", lambda x, i: i != F.col("__k"))).cast("double"), F.lit(float("-inf"))))
    kept = F.filter("targets", lambda c: c.isNotNull() & (c >= 0) & (c < classes))
    t = _frames_of(words.select(key, "position", "from", "to", kept.alias("__targets")), ranked, key)  # a frame is joined once a word, not once a target
    t = t.select(key, "position", "log_probs", "logits", "__k", "__max", "__next", F.posexplode("__targets").alias("ord", "class"))
    own = F.get("logits", F.col("class")).cast("double")
    rival = F.when(F.col("class") == F.col("__k"), F.col("__next")).otherwise(F.col("__max"))
    best = t.groupBy(key, "position", "ord").agg(F.max(F.get("log_probs", F.col("class")).cast("double")).alias("a"), F.max(own).alias("b"), F.max(own - rival).alias("c"))
    return best.groupBy(key, "position").agg(F.avg("a").alias("log_prob"), F.avg("b").alias("max_logit"), F.avg("c").alias("margin"))


def gop_self_aligned(words: DataFrame, frames: DataFrame, key: str, classes: int, blank: int = 0) -> DataFrame:
    """key, position, self_aligned: mean log-probability of each target over the first segment of the greedy path that
    overlaps the word, clipped to it; -20 where the target was never emitted; mean over targets."""
    segments = sequence.greedy_path(frames, [key], ["t"], "log_probs", blank)
    targets = word_targets(words, classes)
    hit = sequence.first_overlapping(targets, segments, [key], "class")
    hit = hit.withColumns({"from": F.greatest("from", "seg_start"), "to": F.least("to", "seg_stop"), "deleted": F.col("seg_start").isNull()})
    scored = _frames_of(hit.where("NOT deleted"), frames, key).groupBy(key, "position", "ord").agg(F.avg(F.get("log_probs", F.col("class")).cast("double")).alias("score"))
    gone = hit.where("deleted").select(key, "position", "ord", F.lit(DELETED).alias("score"))
    return scored.unionByName(gone).groupBy(key, "position").agg(F.avg("score").alias("self_aligned"))


def score_words(words: DataFrame, frames: DataFrame, key: str, head: Callable[[Column], Column], weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """words (key, position, num_words, ...) with score: the head's score of the word's pooled frames (key, t, v); null without frames.

    A word has its proportional span of the utterance's frames. They are pooled to their mean or, with
    weight (a frame's attention logit), to their mean under the softmax of the weights over the span.
    """
    count = frames.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__frames"))
    spans = words.join(count, F.col(key) == F.col("__k"), "left").withColumn("__s", sequence.word_span(F.col("position"), F.col("num_words"), F.col("__frames")))
    asked = spans.where("__s IS NOT NULL").select(key, "position", "num_words", F.col("__s.start").alias("from"), F.col("__s.stop").alias("to")).distinct()
    inside = _frames_of(asked, frames.select(key, "t", "v"), key)
    at = [key, "position", "num_words"]
    if weight is None:
        inside = inside.withColumn("__e", F.lit(1.0))
    else:
        inside = inside.withColumn("__l", weight(F.col("v")))
        top = inside.groupBy(*at).agg(F.max("__l").alias("__m"))
        inside = join_on(inside, top, at).withColumn("__e", F.exp(F.col("__l") - F.col("__m")))
    dims = inside.select(*at, "__e", F.posexplode("v").alias("dim", "x")).groupBy(*at, "dim").agg((F.sum(F.col("__e") * F.col("x")) / F.sum("__e")).alias("x"))
    pooled = dims.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("__pooled"))
    scored = pooled.select(*at, head(F.col("__pooled")).alias("score"))
    return join_on(words, scored, at, "left").select(*words.columns, "score")


def tall(scores: DataFrame, key: str, methods: list[str], human: str) -> DataFrame:
    """method, key, predicted, human: one row per word and method that scored it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("predicted")) for m in methods]))
    return scores.select(key, F.col(human).alias("human"), pairs.alias("p")).select("p.method", key, "p.predicted", "human").where("predicted IS NOT NULL")


def correlations(scored: DataFrame) -> DataFrame:
    """method, n, rho, pearson of a tall table; methods without scores have no row."""
    rho = stats.spearman(scored, ["method"], "predicted", "human")
    r = stats.correlate(scored, ["method"], "predicted", "human", "pearson").select(F.col("method").alias("m"), "pearson")
    return rho.join(r, F.col("method") == F.col("m")).select("method", "n", "rho", "pearson")


def report(scored: DataFrame, cluster: str, replicates: int = REPLICATES) -> DataFrame:
    """method, n, rho, lo, hi, pearson of a tall table: correlations with intervals over resampled clusters."""
    ends = stats.cluster_bootstrap(scored, "predicted", "human", cluster, replicates, group=["method"])
    return join_on(correlations(scored), ends, ["method"]).select("method", "n", "rho", "lo", "hi", "pearson")


def word_counts(scores: DataFrame, methods: list[str], least: int = LEAST_SCORED) -> DataFrame:
    """One row (scored, skipped): words that any method scored, and the others; under `least` scored ones are an error when the row is used."""
    any_ = F.lit(False)
    for m in methods:
        any_ = any_ | F.col(m).isNotNull()
    return scores.agg(F.count_if(any_).alias("scored"), F.count_if(~any_).alias("skipped")).withColumn("scored", at_least(F.col("scored"), least, "words could be scored"))


def markdown(results: DataFrame, counts: DataFrame, title: str = "Evaluation", facts: dict[str, str] | None = None) -> DataFrame:
    """The report as lines (ord, line): title, facts, word counts, a table with a row for each method in the order of METHODS."""
    spark = results.sparkSession
    head = [f"# {title}", "", *[f"- {k}: {v}" for k, v in (facts or {}).items()]]
    table = ["", "| Method | Words | Spearman ρ | 95% CI | Pearson | Description |", "|---|---|---|---|---|---|"]
    fixed = spark.createDataFrame([*[(i, x) for i, x in enumerate(head)], *[(101 + i, x) for i, x in enumerate(table)]], "ord int, line string")
    said = counts.select(F.lit(100).alias("ord"), F.format_string("- Words: %d scored, %d skipped", "scored", "skipped").alias("line"))
    names = spark.createDataFrame([(m, n, d, 200 + i) for i, (m, (n, d)) in enumerate(METHODS.items())], "m string, name string, description string, ord int")
    rows = report_lines(results).join(F.broadcast(names), F.col("method") == F.col("m"))
    rows = rows.select("ord", F.concat(F.lit("| "), "name", F.expr("substring(line, length(method) + 3)"), F.lit(" "), "description", F.lit(" |")).alias("line"))
    return fixed.unionByName(said).unionByName(rows)


def best_method(results: DataFrame, order: str) -> DataFrame:
    """The row with the highest rho; of equal ones the last in order."""
    return results.agg(F.max(F.struct("rho", order, "method")).alias("b")).select("b.method", "b.rho")


def decimals(column: str, places: int = 4) -> Column:
    """A number with so many decimals, rounded from the double's exact value, ties to even, as C, Rust and SQL print it.

    format_string rounds the shortest decimal digits half up: -0.45685, a little above that in binary, becomes -0.4569 instead of -0.4568.
    """
    fixed = F.udf(lambda x: format(x, f".{places}f"), "string")
    x = F.col(column).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, fixed(F.when(finite, x).otherwise(0.0))).otherwise(F.coalesce(x.cast("string"), F.lit("null")))


def report_lines(results: DataFrame) -> DataFrame:
    """Markdown table rows, four decimals."""
    line = F.format_string("| %s | %d | %s | [%s, %s] | %s |", "method", "n", *[decimals(c) for c in ("rho", "lo", "hi", "pearson")])
    return results.select("method", line.alias("line"))
