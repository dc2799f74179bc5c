"""Teacher features beside a student's: which utterances have them, matched frames, distillation loss, scores from them.

Student frames are rows (key, t, v) at 100 a second, teacher frames rows (key, t, v) at 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import evaluate, stats

LEAST_MATCHED = 10


def retained(utterances: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """Utterances that have teacher features; an error when the result is used if none has."""
    kept = utterances.join(teacher.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")
    return evaluate.never_empty(kept, "no training utterance has teacher features")


def with_teacher(utterances: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """All utterances, with the teacher's columns where there are any."""
    named = teacher.withColumnRenamed(key, "__key")
    return utterances.join(named, F.col(key) == F.col("__key"), "left").drop("__key")


def matched_frames(student: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """key, t (the teacher's), student and teacher vectors: every second student frame meets the teacher's of half its place.

    A last student frame without a second one beside it has no partner, nor has a teacher frame beyond the student's.
    """
    even = student.where(F.col("t") % 2 == 0).select(key, F.floor(F.col("t") / 2).alias("t"), F.col("v").alias("student"))
    pairs = student.where(F.col("t") % 2 == 1).select(F.col(key).alias("__k"), F.floor(F.col("t") / 2).alias("__t"))
    whole = even.join(pairs, (F.col(key) == F.col("__k")) & (F.col("t") == F.col("__t")), "left_semi")
    other = teacher.select(F.col(key).alias("__k"), F.col("t").cast("long").alias("__t"), F.col("v").alias("teacher"))
    return whole.join(other, (F.col(key) == F.col("__k")) & (F.col("t") == F.col("__t"))).drop("__k", "__t")


def distillation_loss(student: DataFrame, teacher: DataFrame, key: str, project: Callable[[Column], Column]) -> DataFrame:
    """key, frames, loss: mean squared gap between matched student frames and projected teacher frames; utterances without any are left out."""
    gaps = F.zip_with("student", project(F.col("teacher")), lambda a, b: (a - b) * (a - b))
    m = matched_frames(student, teacher, key).select(key, F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("s"), F.size("student").alias("d"))
    return m.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), (F.sum("s") / F.sum("d")).alias("loss"))


def evaluate_head(words: DataFrame, teacher: DataFrame, key: str, human: str, head: Callable[[Column], Column], least: int = LEAST_MATCHED) -> DataFrame:
    """One row (n, rho, pearson) of a head that scores words (key, position, num_words, human) from teacher frames.

    Words without teacher features or frames take no part; fewer than `least` of them are an error when the row is used.
    """
    scored = evaluate.score_words(words, teacher, key, head).where(F.col("score").isNotNull() & F.col(human).isNotNull()).select(F.col("score").alias("x"), F.col(human).cast("double").alias("y"))
    n = scored.agg(F.count(F.lit(1)).alias("words")).withColumn("words", evaluate.at_least(F.col("words"), least, "words matched the teacher cache"))
    both = stats.spearman(scored, [], "x", "y").crossJoin(F.broadcast(stats.correlate(scored, [], "x", "y", "pearson").select("pearson")))  # one row each
    return n.crossJoin(F.broadcast(both)).select(F.col("words").alias("n"), "rho", "pearson")
