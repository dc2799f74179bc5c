"""Feature caches as a Spark data source: `spark.read.format("feature_cache").load(folder)`, and the writer for it.

A cache is a folder of records, sample_000003.bin for the utterance with index 3 (skipped ones leave
gaps), and manifest.json, which lists them with the totals. Files are reached through pyarrow's file
systems, so the folder may be in an object store.

Writing: each task writes its records and, beside them, a fragment of the manifest's list, and
returns their names and sums; `commit` joins the fragments of the tasks that count, piece by piece, into
the manifest, so neither lists nor records pass through the driver whole. A record's name and bytes
follow from its row: a task that runs again puts the same bytes under the same name. `abort`
removes what the job wrote; the folder must be new or empty.

Reading: partitions are ranges of the folder's files, BYTES each about. A record that cannot be
decoded is a row with an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cadenza.operators.common import join_on
from cadenza.sources.binary import MODE_OF_DIM, decode_record, encode_record

#: Bytes of a partition when reading, of a piece when joining fragments.
BYTES, PIECE = 64 << 20, 8 << 20
#: Records of an Arrow batch.
BATCH = 64
MANIFEST, ENTRIES = "manifest.json", "_entries"
ENTRY = "index long, num_frames int, num_targets int, oov_count int, audio_path string"
SCHEMA = "index long, features array<float>, targets array<int>, num_frames int, error string"
# Fixed value: the name of a record.
NAME = "sample_{:06}.bin"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _replaced(store: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    """Write a file whole or not at all: object stores do so by themselves, others by a name of its own first."""
    own = path if store.type_name in ("s3", "gcs", "abfs") else f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    if own != path:
        store.move(own, path)


@dataclass
class Range(InputPartition):
    """Files (index, path) that one task reads."""

    files: list[tuple[int, str]]

    def __init__(self, files: list[tuple[int, str]]) -> None:
        super().__init__(files)
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its place among the tasks, the fragment's name, records, frames, words made up by rule."""

    task: int
    fragment: str | None
    records: int
    frames: int
    oov: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        known = {k.lower(): v for k, v in options.items()}
        self.path, self.dim = known["path"], int(known["featuredim"]) if "featuredim" in known else None

    def partitions(self) -> list[Range]:
        store, path = place(self.path)
        found = sorted((f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("sample_") and f.base_name.endswith(".bin"))
        ranges, size = [[]], 0
        for name, n in found:
            if size >= BYTES:
                ranges.append([])
                size = 0
            ranges[-1].append((int(name[7:-4]), f"{path}/{name}"))
            size += n
        return [Range(r) for r in ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = place(self.path)
        kinds = [pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int32()), pa.int32(), pa.string()]
        for at in range(0, len(partition.files), BATCH):
            rows = []
            for index, name in partition.files[at : at + BATCH]:
                with store.open_input_stream(name) as f:
                    data = f.read()
                try:
                    dim = self.dim if self.dim is not None else stored_dim(data)
                    got = decode_record(data, dim)
                    rows.append((index, got["features"], got["targets"], got["num_frames"], None))
                except ValueError as e:
                    rows.append((index, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["index", "features", "targets", "num_frames", "error"])


def stored_dim(data: bytes) -> int:
    """Dimension of a record that names it (version 2)."""
    if len(data) < 20 or data[4:8] != b"\2\0\0\0":
        raise ValueError("the record does not name its dimension: featureDim must")
    return int.from_bytes(data[16:20], "little")


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool) -> None:
        known = {k.lower(): v for k, v in options.items()}
        self.path, self.names, self.job = known["path"], names, uuid.uuid4().hex
        self.dim = {v: k for k, v in MODE_OF_DIM.items()}[known["mode"]]
        seconds = known.get("maxdurationsecs")
        self.head = {"feature_dim": self.dim, "feature_mode": known["mode"], "data_dir": known.get("datadir", ""), "split": known.get("split", ""), "max_duration_secs": float(seconds) if seconds else None}
        if missing := {"index", "audio_path", "features", "targets", "oov_count"} - set(names):
            raise ValueError(f"columns missing: {sorted(missing)}")
        store, path = place(self.path)
        store.create_dir(path)
        if store.get_file_info(fs.FileSelector(path)):
            if not overwrite:
                raise ValueError(f"{self.path} is not empty")
            store.delete_dir_contents(path)
        store.create_dir(f"{path}/{ENTRIES}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = place(self.path)
        task, fragment = TaskContext.get().partitionId(), f"{path}/{ENTRIES}/{self.job}-{uuid.uuid4().hex}.json"
        totals = [0, 0, 0]

        def lines() -> Iterator[bytes]:
            for batch in iterator:
                for at in range(0, batch.num_rows, BATCH):
                    for r in batch.slice(at, BATCH).to_pylist():
                        features, targets = np.asarray(r["features"] or [], "<f4"), r["targets"] or []
                        _replaced(store, f"{path}/{NAME.format(r['index'])}", iter([encode_record(features, self.dim, targets)]))
                        entry = {"index": r["index"], "num_frames": features.size // self.dim, "num_targets": len(targets), "oov_count": r["oov_count"] or 0, "audio_path": r["audio_path"] or ""}
                        totals[:] = totals[0] + 1, totals[1] + entry["num_frames"], totals[2] + entry["oov_count"]
                        yield json.dumps(entry).encode() + b"\n"

        _replaced(store, fragment, lines())
        if not totals[0]:
            store.delete_file(fragment)
        return Written(task, fragment if totals[0] else None, *totals)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        kept = {m.fragment for m in done}
        for f in store.get_file_info(fs.FileSelector(f"{path}/{ENTRIES}")):
            if f.base_name.startswith(self.job) and f"{path}/{ENTRIES}/{f.base_name}" not in kept:
                store.delete_file(f.path)  # of a task that ran twice
        if not sum(m.records for m in done):
            raise ValueError("no usable utterances")
        head = self.head | {"num_samples": sum(m.records for m in done), "total_frames": sum(m.frames for m in done), "total_oov": sum(m.oov for m in done)}

        def body() -> Iterator[bytes]:
            yield json.dumps(head)[:-1].encode() + b', "samples": ['
            between = b"\n"
            for m in done:
                if m.fragment is not None:
                    with store.open_input_stream(m.fragment) as f:
                        while piece := f.read(PIECE):
                            yield between + piece.removesuffix(b"\n").replace(b"\n", b",\n")
                            between = b",\n" if piece.endswith(b"\n") else b""
            yield b"\n]}\n"

        _replaced(store, f"{path}/{MANIFEST}", body())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = place(self.path)
        store.delete_dir_contents(path)


class FeatureCache(DataSource):
    """Options: path; for reading featureDim (of records that do not name it); for writing mode, dataDir, split, maxDurationSecs."""

    @classmethod
    def name(cls) -> str:
        return "feature_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema.names, overwrite)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: a cache's manifest without its list; the feature mode follows from the dimension where it is missing, an error if they do not fit."""
    head = "feature_dim int, feature_mode string, num_samples long, total_frames long, total_oov long, data_dir string, split string, max_duration_secs double"
    m = spark.read.option("multiLine", True).schema(head).json(f"{path}/{MANIFEST}")
    modes = F.create_map(*[F.lit(x) for kv in MODE_OF_DIM.items() for x in kv])
    mode = F.coalesce(F.when(F.col("feature_mode") == "log_mel80", "logmel80").otherwise(F.col("feature_mode")), modes[F.col("feature_dim")])
    fits = F.coalesce(modes[F.col("feature_dim")] == mode, F.lit(False))
    hint = F.concat(F.lit("dimension "), F.coalesce(F.col("feature_dim").cast("string"), F.lit("missing")), F.lit(" does not fit mode "), F.coalesce(mode, F.lit("missing")), F.lit(": compute the features anew in the other mode"))
    return m.withColumn("feature_mode", F.when(fits, mode).otherwise(F.raise_error(hint)))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's list: from its fragments, in as many tasks as they ask for, or, of caches that have none, from the manifest itself."""
    store, folder = place(path)
    if any(f.base_name.endswith(".json") for f in store.get_file_info(fs.FileSelector(f"{folder}/{ENTRIES}", allow_not_found=True))):
        return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{path}/{ENTRIES}/*.json")
    listed = spark.read.option("multiLine", True).schema(f"samples array<struct<{ENTRY.replace(', ', ',').replace(' ', ':')}>>").json(f"{path}/{MANIFEST}")
    return listed.select(F.inline("samples"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries joined to their records: index, audio_path, oov_count, features, targets, num_frames, error."""
    spark.dataSource.register(FeatureCache)
    dim = read_manifest(spark, path).first()["feature_dim"]
    d = spark.read.format("feature_cache").option("featureDim", dim).load(path)
    d = d.select("index", "features", "targets", F.col("num_frames").alias("__frames"), F.col("error").alias("__error"), F.lit(True).alias("__there"))
    joined = join_on(read_entries(spark, path), d, ["index"], "left")
    off = (F.col("__frames") != F.col("num_frames")) | (F.size("targets") != F.col("num_targets"))
    error = F.when(F.col("__there").isNull(), "no file").when(off, "counts differ from the manifest").otherwise(F.col("__error"))
    return joined.select("index", "audio_path", "oov_count", "features", "targets", "num_frames", error.alias("error"))


def write_cache(samples: DataFrame, path: str, mode: str, data_dir: str = "", split: str = "", max_duration: float | None = None, overwrite: bool = False) -> None:
    """Write samples (index, audio_path, features, targets, oov_count) as a cache, in the order of their index. No samples are an error."""
    samples.sparkSession.dataSource.register(FeatureCache)
    ordered = samples.select("index", "audio_path", "features", "targets", "oov_count").repartitionByRange("index").sortWithinPartitions("index")
    out = ordered.write.format("feature_cache").mode("overwrite" if overwrite else "append").option("mode", mode).option("dataDir", data_dir).option("split", split)
    (out if max_duration is None else out.option("maxDurationSecs", max_duration)).save(path)
