"""Documents to training tokens: five stages, each written as Parquet and read again by the next.

toxicity -> line dedup -> near-duplicate removal -> mixing sources -> SentencePiece ids.
The first four return the columns of documents; n_chars, where there is one, follows the text.

Defined results, for all stages: null and empty texts pass as they are (no words, so mixing
takes none); texts of any length are worked on whole; columns beyond doc_id and text, whatever
their names (score, size, n_lines, ...), are carried along unchanged, those of mixing also need
source; names that begin with "__" are kept for the stages' own columns; rows that repeat are
rows of their own except in near-duplicate removal, where one stays; an empty table gives an
empty one with the same columns. Ties are named at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import line_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from cadenza.llm.common import table, written


#: Seed of the hash that rounds a document's share to whole documents.
ROUNDING = 17


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the classifier learns from the labels of the same table."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, keep=docs.columns, out="__score").where("__score < 0.5").drop("__score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of repeated three-line windows; one that has lost all its lines goes.

    Of equal windows the first by doc_id (null first), hash of the text and position stays.
    """
    cleaned = line_dedup.dedup_lines(docs, prefix="__")
    return _resized(cleaned.where("__n_lines = 0 OR __n_removed < __n_lines").select(*docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the row with the smallest doc_id (null last), then the smallest hash of its text, then of its columns."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document as often as its words are taken whole, and once more, whole, if a seeded hash below its size falls below the words that are left over.

    So a document in which a block ends is never cut, and a source's words are as many as taken on average.
    The order inside a shard is by a seeded hash of doc_id, then doc_id, size and hash of the text.
    """
    mixed = mixing.mix(docs, prefix="__")
    size = F.greatest(F.col("__size"), F.lit(1))  # what takes no words is filtered below, but perhaps after this
    lot = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(ROUNDING)), size)
    times = F.floor(F.col("__taken") / size) + F.when(lot < F.col("__taken") % size, 1).otherwise(0)
    out = mixed.where("__taken > 0").withColumn("__one", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids of every document of the mix, their number, and a digest of what they decode to."""
    import public_tokenizers

    narrow = docs.select("doc_id", "lang", "source", "text")
    return sentencepiece_codec.encode_documents(narrow, public_tokenizers.path("piece_bpe_32k.model"), results=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
#: SQL cannot express the classifier, the signatures and the encoder: tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
