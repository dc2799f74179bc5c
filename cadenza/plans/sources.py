"""Queries over binary formats and scored words, and the SQL that checks them.

Embeddings stand for features, teacher features and signals, documents for sentences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import phonemes as ph
from cadenza.sources import binary, text

DIM = 8


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")


def _total(values: str) -> Column:
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)


def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature records of frames of eight dimensions with two targets, written and read back."""
    v = _vectors(spark, sf_dir).select("vec_id", "embedding", F.lit(DIM).alias("dim"), F.array(F.col("vec_id") % 41 + 1, F.col("label")).cast("array<int>").alias("classes"))
    stored = binary.encoded(v, binary.encode_record, ["embedding", "dim", "classes"]).select("vec_id", F.length("content").alias("bytes"), "content")
    got = binary.decoded(stored, lambda data: binary.decode_record(data, DIM))
    return got.select("vec_id", "bytes", "num_frames", F.concat_ws(" ", F.col("targets").cast("array<string>")).alias("targets"), _total("features").alias("total"), "error")


def teacher_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher records of two frames, the embedding over and over; every seventh manifest entry tells a wrong number of frames."""
    long = F.flatten(F.array_repeat("embedding", F.ceil(F.lit(2 * binary.TEACHER_DIM) / F.greatest(F.size("embedding"), F.lit(1))).cast("int")))
    v = _vectors(spark, sf_dir).select("vec_id", F.slice(long, 1, 2 * binary.TEACHER_DIM).alias("features"), F.when(F.col("vec_id") % 7 == 0, 3).otherwise(2).alias("frames"))
    stored = binary.encoded(v, binary.encode_teacher, ["features"]).select("vec_id", "frames", "content")
    got = binary.decoded(stored, binary.decode_teacher, args=["frames"])
    return got.select("vec_id", "num_frames", F.get("features", F.lit(binary.TEACHER_DIM + 1)).cast("double").alias("second"), "error")


def wav_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 16-bit waves, read back; every fifth is cut before its format."""
    stored = binary.encoded(_vectors(spark, sf_dir).select("vec_id", "embedding"), lambda x: binary.encode_wave(np.array(x, float)), ["embedding"])
    cut = F.when(F.col("vec_id") % 5 == 0, F.substring("content", 1, 12)).otherwise(F.col("content"))
    got = binary.decoded(stored.select("vec_id", cut.alias("content")), binary.decode_wave)
    return got.select("vec_id", "num_frames", "rate", _total("features").alias("total"), "error")


def word_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored word for each document: some positions are beyond the sentence, some scores over 1."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = d.select("doc_id", (F.col("doc_id") % 400).alias("word_position"), ph.word_total(F.col("text")).cast("long").alias("num_words"), (F.col("doc_id") % 12 / 10.0).alias("human_score"))
    return w.select("doc_id", "word_position", "num_words", text.word_valid(F.col("word_position"), F.col("num_words"), F.col("human_score")).alias("valid"))


QUERIES = {f.__name__: f for f in (cache_roundtrip, teacher_cache, wav_decode, word_validity)}
ORACLE = {
    "cache_roundtrip": f"""select vec_id, (4 * (5 + len(embedding) + 2))::integer as bytes, (len(embedding) // {DIM})::integer as num_frames, (vec_id % 41 + 1) || ' ' || label as targets,
round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total, null::varchar as error from embeddings""",
    "teacher_cache": f"""select vec_id, case when vec_id % 7 <> 0 then 2 end as num_frames, case when vec_id % 7 <> 0 then embedding[({binary.TEACHER_DIM} + 1) % len(embedding) + 1]::double end as second,
case when vec_id % 7 = 0 then '2 frames, the manifest says 3' end as error from embeddings""",
    "wav_decode": f"""select vec_id, case when vec_id % 5 <> 0 then len(embedding)::integer end as num_frames, case when vec_id % 5 <> 0 then {binary.RATE} end as rate,
case when vec_id % 5 <> 0 then round(list_sum(list_transform(embedding, lambda x: round(greatest(-1, least(1, x::double)) * 32767) / 32768)), 6) end as total, case when vec_id % 5 = 0 then 'no format or no data' end as error from embeddings""",
    "word_validity": """select doc_id, doc_id % 400 as word_position, n as num_words, coalesce(doc_id % 400 < n and doc_id % 12 / 10.0::double between 0 and 1, false) as valid
from (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::bigint as n from documents)""",
}
