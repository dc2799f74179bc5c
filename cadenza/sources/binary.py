"""Binary records: feature caches, teacher features, wave files.

Files are read with Spark's binaryFile source, so any store will do, and decoded in Arrow
batches. A file that cannot be decoded is a row with an error, not a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record formats.
CACHE_MAGIC, CACHE_VERSION, TEACHER_MAGIC, TEACHER_VERSION, TEACHER_DIM, RATE = b"MFCC", 2, b"W2V2", 1, 1024, 16_000
#: Rows that are decoded or encoded together.
PART = 64
MODE_OF_DIM = {39: "mfcc39", 80: "logmel80"}


def encode_record(features: np.ndarray, dim: int, targets: list[int]) -> bytes:
    """Cache record, version 2, little endian."""
    values = np.asarray(features, "<f4").ravel()
    if values.size % max(dim, 1):
        raise ValueError(f"{values.size} features are no rows of {dim}")
    return CACHE_MAGIC + struct.pack("<4I", CACHE_VERSION, values.size // max(dim, 1), len(targets), dim) + values.tobytes() + np.asarray(targets, "<i4").tobytes()


def decode_record(data: bytes, dim: int) -> dict:
    """Cache record of version 1 or 2; ValueError says what is wrong."""
    words = np.frombuffer(data[: len(data) // 4 * 4], "<u4")
    if data[:4] != CACHE_MAGIC:
        raise ValueError("bad magic")
    if len(words) < 4:
        raise ValueError("truncated header")
    version, frames, targets = (int(x) for x in words[1:4])
    if version not in (1, 2):
        raise ValueError(f"unsupported version {version}")
    head = 3 + version
    if version == 2:
        if len(words) < 5:
            raise ValueError("truncated header")
        if int(words[4]) != dim:
            raise ValueError(f"feature_dim {int(words[4])} differs from {dim}")
    expected = 4 * (head + frames * dim + targets)
    if len(data) != expected:
        raise ValueError(f"expected {expected} bytes, found {len(data)}")
    return {"features": np.frombuffer(data, "<f4", frames * dim, 4 * head), "targets": np.frombuffer(data, "<i4", targets, 4 * (head + frames * dim)), "num_frames": frames, "rate": None}


def encode_teacher(features: np.ndarray) -> bytes:
    """Teacher features, 1,024 dimensions a frame, little endian."""
    values = np.asarray(features, "<f4").ravel()
    if values.size % TEACHER_DIM:
        raise ValueError(f"{values.size} features are no rows of {TEACHER_DIM}")
    return TEACHER_MAGIC + struct.pack("<3I", TEACHER_VERSION, values.size // TEACHER_DIM, TEACHER_DIM) + values.tobytes()


def decode_teacher(data: bytes, frames: int | None = None) -> dict:
    """Teacher features: 1,024 dimensions a frame; frames, if given, must match."""
    if data[:4] != TEACHER_MAGIC or len(data) < 16:
        raise ValueError("bad magic")
    version, n, dim = struct.unpack_from("<3I", data, 4)
    if version != TEACHER_VERSION or dim != TEACHER_DIM:
        raise ValueError(f"unsupported version {version} or dimension {dim}")
    if frames is not None and n != frames:
        raise ValueError(f"{n} frames, the manifest says {frames}")
    if len(data) != 16 + 4 * n * dim:
        raise ValueError(f"expected {16 + 4 * n * dim} bytes, found {len(data)}")
    return {"features": np.frombuffer(data, "<f4", n * dim, 16), "targets": None, "num_frames": n, "rate": None}


def decode_wave(data: bytes) -> dict:
    """RIFF/WAVE with integer or float samples to mono float32; the rate must be 16 kHz."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif kind == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("no format or no data")
    coding, channels, rate, _, _, bits = form
    if rate != RATE:
        raise ValueError(f"sample rate {rate}, {RATE} is needed")
    whole = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
    if coding == 3 and bits in (32, 64):
        x = np.frombuffer(whole, f"<f{bits // 8}").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(whole, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(whole, "<i2").astype(np.float32) / 2**15
    elif bits == 24:
        raw = np.frombuffer(whole, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    elif bits == 32:
        x = np.frombuffer(whole, "<i4").astype(np.float32) / 2**31
    else:
        raise ValueError(f"coding {coding} with {bits} bits is not supported")
    if not len(x):
        raise ValueError("no samples")
    return {"features": x.reshape(-1, channels).mean(axis=1), "targets": None, "num_frames": len(x) // channels, "rate": rate}


def encode_wave(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono RIFF/WAVE."""
    body = np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def encoded_batches(batches: Iterator[pa.RecordBatch], encode: Callable[..., bytes], at: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches plus the binary form of their rows; no more than PART rows are Python objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, PART):
            part = batch.slice(low, PART)
            made = [encode(*values) for values in zip(*(part.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=names)


def encoded(rows: DataFrame, encode: Callable[..., bytes], args: list[str], content: str = "content") -> DataFrame:
    """rows plus their binary form. args: columns passed on to encode."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{content}` binary"])
    names, at = [*rows.columns, content], [rows.columns.index(a) for a in args]

    return rows.mapInArrow(lambda batches: encoded_batches(batches, encode, at, names), schema)


def decoded(files: DataFrame, decode: Callable[..., dict], content: str = "content", args: list[str] | None = None) -> DataFrame:
    """files without content, plus features, targets, num_frames, rate and error. args: columns passed on to decode."""
    args = args or []
    keep = [c for c in files.columns if c != content]
    source = files.select(*keep, content)
    schema = ", ".join([*(f"`{source.schema[c].name}` {source.schema[c].dataType.simpleString()}" for c in keep), "features array<float>, targets array<int>, num_frames int, rate int, error string"])
    empty = {"features": None, "targets": None, "num_frames": None, "rate": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                extra = [part.column(keep.index(a)).to_pylist() for a in args]
                rows = []
                for i, data in enumerate(part.column(len(keep)).to_pylist()):
                    try:
                        rows.append(decode(data or b"", *(x[i] for x in extra)) | {"error": None})
                    except (ValueError, struct.error) as e:
                        rows.append(empty | {"error": str(e)})
                cols = [pa.array([r[k] for r in rows], t) for k, t in (("features", pa.list_(pa.float32())), ("targets", pa.list_(pa.int32())), ("num_frames", pa.int32()), ("rate", pa.int32()), ("error", pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*keep, "features", "targets", "num_frames", "rate", "error"])

    return source.mapInArrow(run, schema)


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """path, file, samples, sample_rate, error of all wave files below a folder."""
    return decoded(binary_files(spark, path, "*.wav"), decode_wave).select("path", "file", F.col("features").alias("samples"), F.col("rate").alias("sample_rate"), "error")


def read_teacher(spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str = "audio_file") -> DataFrame:
    """audio_file, features, num_frames, error. wanted: keep its rows, with nulls where the cache has none."""
    m = spark.read.option("multiLine", True).schema("files map<string,struct<bin:string,frames:int>>").json(f"{path}/manifest.json")
    entries = m.select(F.explode("files").alias("audio_file", "e")).select("audio_file", "e.bin", "e.frames")
    files = binary_files(spark, path, "*.bin")
    d = decoded(entries.join(files, F.col("bin") == F.col("file")).select("audio_file", "frames", "content"), decode_teacher, args=["frames"]).select("audio_file", "features", "num_frames", "error")
    if wanted is None:
        return d
    return wanted.join(d.withColumnRenamed("audio_file", "__a"), F.col(key) == F.col("__a"), "left").drop("__a")
