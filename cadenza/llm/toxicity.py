"""Toxicity scores from a character n-gram linear classifier with naive Bayes scaled features.

Features: the distinct character n-grams (n = 2 to 5) of the lower-case text, each word
between blanks and none running over a blank, hashed to 2^18 buckets. A bucket's feature
is its naive Bayes log-count ratio, log((p/|p|) / (q/|q|)), where the bucket occurs in
the text, else 0 (Wang and Manning, 2012); ratios below 0.7 either way count as 0. A logistic model is fitted on these features.

Training uses at most TRAIN_ROWS labelled documents (a documented bound; in the order of a
seeded hash of doc_id, so reruns agree), whatever their length, never those held out:
crc32(doc_id as text) mod 5 is 0. Their buckets are computed on the executors, counted there
by label, and only buckets that tell the labels apart are kept, in the shared folder; the
driver fits the weights in blocks, held in memory up to HELD bytes, else read again for each
round. Scoring reads every whole text; labels, lang, source and doc_id play no part in it.

Defined results: null texts count as empty, empty texts get the score of the intercept;
documents that have several labels count as toxic if one of them says so; of rows that
repeat a labelled doc_id the one with the least hash of its text is learned from, all are
scored; null labels are left out; without labels of both kinds every score is the share of
toxic labels (0 without any). An empty table gives no rows. Further columns are carried
along, but for one with the name of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import carried, dropped, table, written

SIZES, BITS = (2, 3, 4, 5), 18
TRAIN_TASKS = 16
#: Buckets of rows that the fit works on together, and bytes of buckets that it holds in memory (4 a bucket; a row has 2^BITS at most).
BLOCK, HELD = 1_000_000, 256_000_000
TRAIN_ROWS, SEED, ROUNDS, RATE, POSITIVE_WEIGHT, RIDGE, LEAST_RATIO = 6000, 11, 120, 0.08, 4.0, 1e-6, 0.7


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def buckets(text: str | None) -> np.ndarray:
    """Distinct n-gram buckets of a text."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int32)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    found, h, inner = [], codes + np.uint64(1), None
    for n in range(2, SIZES[-1] + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        # positions 1 .. n - 2 of the n-gram must not be blank
        if n > 2:
            inner = blank[1 : len(h) + 1] if inner is None else inner[:-1] | blank[n - 2 : n - 2 + len(h)]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ids = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
            found.append(ids if inner is None else ids[~inner])
    ids = np.concatenate(found)
    mark = _scratch()
    order = np.arange(len(ids), dtype=np.int32)
    mark[ids] = order  # the last of equal buckets stays
    return ids[mark[ids] == order]


_MARK: list[np.ndarray] = []


def _scratch() -> np.ndarray:
    if not _MARK:
        _MARK.append(np.zeros(1 << BITS, np.int32))
    return _MARK[0]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(rows: Iterable[tuple[bytes, int]]) -> Iterator[Block]:
    """(labels of the rows, buckets end to end, row of each): about BLOCK buckets together, so no array is as long as all of them."""
    held, n = [], 0

    def close() -> Block:
        parts = [np.frombuffer(r, np.int32) for r, _ in held]
        return np.array([y for _, y in held], np.float64), np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])

    for ids, y in rows:
        held.append((ids, y))
        n += len(ids) // 4
        if n >= BLOCK:
            yield close()
            held, n = [], 0
    if held:
        yield close()


def log_count_ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Of every bucket, from the rows of each label that have it; 0 where it is about as frequent in either label."""
    ratio = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum())
    ratio[np.abs(ratio) < LEAST_RATIO] = 0.0
    return ratio


def fit(blocks: Callable[[], Iterable[Block]], ratio: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weight of every bucket (log-count ratio times coefficient) and the intercept; blocks() gives the n rows, with buckets whose ratio is not 0."""
    size = len(ratio)
    ratio = ratio / (np.sqrt(sum((ratio[ids] ** 2).sum() for _, ids, _ in blocks()) / n) or 1.0)
    values = ratio.astype(np.float32)
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        gw, gb = RIDGE * w, 0.0
        for y, ids, of in blocks():
            x = values[ids]
            z = np.bincount(of, weights=x * w[ids], minlength=len(y)) + b
            g = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, POSITIVE_WEIGHT, 1.0) / n
            gw += np.bincount(ids, weights=x * g[of], minlength=size)
            gb += g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return (w * ratio).astype(np.float32), float(b)


def _bucket_rows(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [buckets(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["toxic", "ids"])

    return source.mapInArrow(run, "toxic int, ids binary")


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each label that have a bucket: each task sends one pair of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[1 if y else 0, np.frombuffer(ids, np.int32)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((2, 1 << BITS), np.int64)
    for row in rows.select("toxic", "ids").coalesce(TRAIN_TASKS).mapInArrow(run, "sums binary").collect():  # 4 MB a task, TRAIN_TASKS at most
        total += np.frombuffer(row["sums"], np.int64).reshape(2, -1)
    return total[1].astype(np.float64), total[0].astype(np.float64)


def _telling(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """The rows with the buckets only that are used, in an order of their own (by hash): sums do not depend on the order of arrival."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(used).tobytes())  # 32 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            ids = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[keep[x]].tobytes() for x in ids], pa.binary())], names=["toxic", "ids"])

    kept = rows.select("toxic", "ids").mapInArrow(run, "toxic int, ids binary")
    return kept.withColumn("h", F.xxhash64("ids"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most `rows` labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col(doc_id).alias("__there")).distinct(), F.col("__id") == F.col("__there"), "left_semi")  # a label without a document takes no place
    chosen = known.orderBy(F.xxhash64("__id", F.lit(SEED)), "__id").limit(rows)
    # at most `rows` pairs of ids and labels are broadcast; of rows that share an id one is left by partial aggregation
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(_bucket_rows(sample.select("toxic", "text").repartition(TRAIN_TASKS)), "buckets")
    n, toxic = found.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") != 0).cast("int")), F.lit(0))).first()
    if toxic in (0, n):
        share = toxic / n if n else 0.0
        return np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    ratio = log_count_ratios(*_counted(found))
    telling = written(_telling(found, ratio != 0), "telling")
    dropped(found.sparkSession, found)
    ordered = telling.orderBy("h", "toxic").select("ids", (F.col("toxic") != 0).cast("int"))
    if telling.agg(F.sum(F.length("ids"))).first()[0] <= HELD:
        got = ordered.toArrow()
        held = list(_blocks(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))
        model = fit(lambda: held, ratio, n)
    else:
        model = fit(lambda: _blocks((bytes(r[0]), r[1]) for r in ordered.toLocalIterator()), ratio, n)
    dropped(telling.sparkSession, telling)
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """docs[keep] plus the score (double, 0 to 1) in column out."""
    keep = carried(docs, (out.lower(),), text) if keep is None else [c for c in keep if c.lower() != out.lower()]
    at, k = (keep.index(text) if text in keep else len(keep)), len(keep)
    source = docs.select(*keep) if text in keep else docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1]))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, intercept = shared.value
        w = np.frombuffer(raw, np.float32)
        for batch in batches:
            z = np.array([float(w[buckets(t)].sum(dtype=np.float64)) for t in batch.column(at).to_pylist()]) + intercept
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=schema.names)

    return source.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
