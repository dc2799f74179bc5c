"""Text sources: transcripts, pronunciation dictionaries, word scores, metric lines."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.sources import json_blocks

SCORES = "audio_file string, sentence_text string, word_position long, human_score double, human_score_raw int, phonemes array<string>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, transcript, folder, utt_file from the *.trans.txt files below a folder; lines without a blank are skipped."""
    lines = spark.read.option("pathGlobFilter", "*.trans.txt").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line"))
    cut = F.split("line", " ", 2)
    return lines.where(F.size(cut) == 2).select(cut[0].alias("utt_id"), F.trim(cut[1]).alias("transcript"), F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("file", r"([^/]*)$", 1).alias("utt_file"))


def scan_split(spark: SparkSession, data_dir: str, split: str) -> DataFrame:
    """read_transcripts of a split's folder (data_dir/split, or data_dir/split/split where there is one), sorted by path, then by line.

    A missing folder and one without utterances are errors.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{data_dir.rstrip('/')}/{split}")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root) or not store.getFileStatus(root).isDirectory():
        raise ValueError(f"split directory not found: {root.toString()}")
    nested = hadoop.Path(root, split)
    root = nested if store.exists(nested) and store.getFileStatus(nested).isDirectory() else root
    found = read_transcripts(spark, root.toString()).withColumn("__line", F.monotonically_increasing_id())
    if found.isEmpty():
        raise ValueError(f"no utterances found under {root.toString()}")
    return found.orderBy("folder", "utt_file", "__line").drop("__line")


def with_audio(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """Transcripts with the audio file of their name in their folder (flac before wav); audio_path is null where none is."""
    plain = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9]+):/+", "$1:/")  # noqa: E731  # readers write one or three slashes after a scheme
    f = files.select("path", F.regexp_extract(plain("path"), r"^(.*)/[^/]*$", 1).alias("__folder"), F.regexp_extract("path", r"([^/]+)\.(?:flac|wav)$", 1).alias("__id"))
    best = f.where("__id != ''").groupBy("__folder", "__id").agg(F.min_by("path", F.col("path").endswith(".wav")).alias("audio_path"))
    return transcripts.join(best, (F.col("utt_id") == F.col("__id")) & (plain("folder") == F.col("__folder")), "left").drop("__id", "__folder")


def missing_audio(transcripts: DataFrame) -> DataFrame:
    """One row of with_audio's result: listed, missing (ids without an audio file) and first_missing."""
    none = F.col("audio_path").isNull()
    return transcripts.agg(F.count(F.lit(1)).alias("listed"), F.count_if(none).alias("missing"), F.min(F.when(none, F.col("utt_id"))).alias("first_missing"))


def read_word_scores(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per word in file order; the limit counts words before any check. raw defaults to ten times the score, phonemes to none."""
    s = json_blocks.array_objects(spark, path, "samples", SCORES).select(F.col("ord").cast("int").alias("ord"), F.col("value").alias("s"))
    if limit is not None:
        s = s.where(F.col("ord") < limit)
    raw = F.coalesce("s.human_score_raw", F.round(F.col("s.human_score") * 10).cast("int"))
    w = s.select("ord", "s.audio_file", "s.sentence_text", "s.word_position", "s.human_score", raw.alias("raw_score"), F.coalesce("s.phonemes", F.array().cast("array<string>")).alias("phonemes"))
    w = w.withColumn("num_words", ph.word_total(F.col("sentence_text")).cast("long"))
    return w.withColumn("valid", word_valid(F.col("word_position"), F.col("num_words"), F.col("human_score")))


def word_valid(position: Column, words: Column, score: Column) -> Column:
    """Whether a scored word is in its sentence and its score within 0 and 1; missing values are not valid."""
    return F.coalesce((position < words) & score.between(0, 1), F.lit(False))


def group_words(words: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Valid words by audio file, members by position (ties in file order)."""
    cols = ["word_position", "ord", "human_score", "raw_score", *(extra or [])]
    return words.where("valid").groupBy("audio_file").agg(F.min_by("sentence_text", "ord").alias("sentence_text"), F.array_sort(F.collect_list(F.struct(*cols))).alias("words"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, phones (classes): first pronunciation of each word; comments and further pronunciations are skipped.

    A phoneme outside the inventory is an error when the row is used.
    """
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    first_comment = F.array_position(F.transform("p", lambda x: x.startswith("#")), F.lit(True)).cast("int")
    p = lines.select("n", parts.alias("p")).select("n", F.when(first_comment > 0, F.slice("p", 1, first_comment - 1)).otherwise(F.col("p")).alias("p"))
    p = p.where((F.size("p") > 1) & ~F.get("p", F.lit(0)).contains("("))
    phones = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda s: F.coalesce(ph.phoneme_class(s), F.raise_error(F.concat(F.lit("unknown phoneme "), s)).cast("int")))
    return p.select(F.lower(F.get("p", F.lit(0))).alias("word"), "n", phones.alias("phones")).groupBy("word").agg(F.min_by("phones", "n").alias("phones"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric lines; lines that are no JSON are skipped."""
    return spark.read.option("mode", "DROPMALFORMED").schema("event string, epoch int, epochs int, elapsed_secs double, loss double, rho double").json(path)


class MetricsWriter:
    """Appends one JSON object a line; a failed write is a warning only."""

    def __init__(self, path: str, append: bool = False, elapsed: float = 0.0) -> None:
        self.path, self.began = path, time.monotonic() - elapsed
        if not append:
            open(path, "w").close()

    def log(self, event: str, fields: object) -> None:
        import logging

        body = fields if isinstance(fields, dict) else {"value": fields}
        clean = {k: None if isinstance(v, float) and v != v else v for k, v in body.items()}
        try:
            with open(self.path, "a") as f:
                f.write(json.dumps({"event": event, **clean, "elapsed_secs": round(time.monotonic() - self.began, 1)}) + "\n")
        except OSError as e:
            logging.getLogger(__name__).warning("metrics were not written: %s", e)
