"""From scanned utterances to training samples and scored words: which are kept, which are skipped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import evaluate, features, g2p, sequence
from cadenza.operators.common import join_on

LEAST_SECONDS, MOST_SECONDS = 0.5, 15.0
REASONS = ("too_short", "too_long", "too_few_frames", "failed")


def skip_reason(seconds: Column, frames: Column, targets: Column, error: Column, most_seconds: float = MOST_SECONDS, audio_error: Column | None = None) -> Column:
    """Why an utterance is skipped, null if it is kept: audio that fails comes first, then its length, then features or targets that fail, then too few frames for the targets."""
    few = ~F.coalesce(sequence.ctc_feasible(targets, frames), F.lit(False))
    audio = F.lit(False) if audio_error is None else audio_error.isNotNull()
    return F.when(audio, "failed").when(seconds < LEAST_SECONDS, "too_short").when(seconds > most_seconds, "too_long").when(error.isNotNull(), "failed").when(few, "too_few_frames")


def skip_report(utterances: DataFrame, order: str, reason: str = "reason", error: str = "error") -> DataFrame:
    """One row: kept, a count for each reason, first_error (by order, of the failed ones)."""
    first = F.min(F.when(F.col(reason) == "failed", F.struct(F.col(order).alias("o"), F.col(error).alias("e"))))
    return utterances.agg(F.count_if(F.col(reason).isNull()).alias("kept"), *[F.count_if(F.col(reason) == r).alias(r) for r in REASONS], first.alias("f")).select("kept", *REASONS, F.col("f.e").alias("first_error"))


def report_lines(report: DataFrame) -> DataFrame:
    """The report in words: a line, and one more if something failed."""
    said = F.format_string("kept %d utterances; skipped %d too short, %d too long, %d with fewer frames than CTC targets, %d failed", "kept", *REASONS)
    more = F.format_string("%d utterances failed to load, first error: %s", "failed", "first_error")
    return report.select(F.posexplode(F.when(F.col("failed") > 0, F.array(said, more)).otherwise(F.array(said))).alias("ord", "line"))


def samples(utterances: DataFrame, waves: DataFrame, dictionary: DataFrame, mode: str, most_seconds: float = MOST_SECONDS) -> DataFrame:
    """Every utterance (index, audio_path, transcript, ...) with features, num_frames, targets, oov_count, seconds, error and the reason it is skipped for.

    waves: path, samples, sample_rate, error. An utterance whose audio is not among them has failed. Only signals of a fitting length are framed.
    """
    w = waves.select(F.col("path").alias("audio_path"), F.col("samples").alias("__samples"), F.col("sample_rate").alias("__rate"), F.col("error").alias("__audio"))
    u = join_on(utterances, w, ["audio_path"], "left").withColumn("__audio", F.when(F.col("__rate").isNull() & F.col("__audio").isNull(), "no audio file").otherwise(F.col("__audio")))
    u = u.withColumn("seconds", F.size("__samples") / F.col("__rate"))
    fits = F.col("seconds").between(LEAST_SECONDS, most_seconds)
    framed = features.acoustic_frames(u.withColumn("__samples", F.when(fits, F.col("__samples"))), mode, "__samples")
    spoken = g2p.transcript_targets(utterances, dictionary, "index", "transcript").select(F.col("doc_id").alias("index"), "targets", F.col("oov_words").alias("oov_count"))
    out = join_on(framed, spoken, ["index"], "left")
    silent = F.when(F.coalesce(F.size("targets"), F.lit(0)) <= 0, "no word of the transcript could be resolved")
    error = F.coalesce("__audio", F.when(fits, F.coalesce("error", silent)))
    out = out.withColumn("error", error).withColumn("reason", skip_reason(F.col("seconds"), F.col("num_frames"), F.col("targets"), F.col("error"), most_seconds, F.col("__audio")))
    return out.drop("__rate", "__audio")


def words_of_failed(words: DataFrame, failed: DataFrame, key: str, methods: list[str]) -> DataFrame:
    """Scored words, without the scores of those whose utterance failed: all of them count as skipped."""
    bad = failed.select(key).distinct().withColumn("__failed", F.lit(True))
    marked = join_on(words, bad, [key], "left")
    return marked.withColumns({m: F.when(F.col("__failed").isNull(), F.col(m)) for m in methods}).drop("__failed")


def evaluated(words: DataFrame, frames: DataFrame, failed: DataFrame, key: str, classes: int, methods: list[str]) -> tuple[DataFrame, DataFrame]:
    """Words with their scores (gop and self-aligned), and one row (scored, skipped), the words of failed utterances and of those without frames among the skipped ones."""
    keys = [key, "position"]
    both = join_on(join_on(words, evaluate.gop_scores(words, frames, key, classes), keys, "left"), evaluate.gop_self_aligned(words, frames, key, classes), keys, "left")
    silent = join_on(words.select(key).distinct(), frames.select(key).distinct(), [key], "left_anti")
    left = words_of_failed(both, failed.select(key).unionByName(silent), key, methods)
    return left, evaluate.word_counts(left, methods)
