"""What a user runs, as functions over folders and tables: a cache of features, an evaluation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import corpus, evaluate, slices
from cadenza.operators.common import settled
from cadenza.sources import binary, cache, text


def utterances(spark: SparkSession, data_dir: str, split: str) -> DataFrame:
    """Utterances of a split that have an audio file: index (place in the scan), utt_id, transcript, audio_path."""
    found = text.scan_split(spark, data_dir, split)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{flac,wav}").load(f"{data_dir.rstrip('/')}/{split}").select("path")
    listed = text.with_audio(found.withColumn("__line", F.monotonically_increasing_id()), files).where("audio_path IS NOT NULL").withColumn("__all", F.lit(1))
    placed = slices.placed(listed, ["__all"], ["folder", "utt_file", "__line"])
    return placed.select(F.col("__t").alias("index"), "utt_id", "transcript", "audio_path")


def precompute(spark: SparkSession, data_dir: str, split: str, dictionary: DataFrame, out: str, mode: str, most_seconds: float = corpus.MOST_SECONDS, overwrite: bool = False) -> DataFrame:
    """Scan a split, decode and frame its audio, resolve its transcripts and write what is usable as a feature cache; one row: kept, skipped by reason, first error.

    Nothing usable is an error, and nothing is left in the folder then.
    """
    listed = settled(utterances(spark, data_dir, split))
    waves = binary.read_waves(spark, f"{data_dir.rstrip('/')}/{split}")
    found = settled(corpus.samples(listed, waves, dictionary, mode, most_seconds).drop("samples"))
    cache.write_cache(found.where("reason IS NULL"), out, mode, data_dir, split, most_seconds, overwrite)
    return corpus.skip_report(found, "index")


def evaluate_words(words: DataFrame, frames: DataFrame, failed: DataFrame, key: str, classes: int, methods: list[str], human: str = "human", replicates: int = evaluate.REPLICATES, facts: dict[str, str] | None = None) -> DataFrame:
    """The report of scored words as Markdown lines (ord, line). words: key, position, from, to, targets, human; failed: keys whose utterance could not be read."""
    scored, counts = corpus.evaluated(words, frames, failed, key, classes, methods)
    results = evaluate.report(evaluate.tall(settled(scored), key, methods, human), key, replicates)
    return evaluate.markdown(results, counts, facts=facts)
