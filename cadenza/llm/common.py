"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, out: tuple[str, ...], *used: str) -> list[str]:
    """Columns that an operator carries along: all but the used ones and those that its results replace."""
    return [c for c in df.columns if c not in used and c.lower() not in out]


def hashable(df: DataFrame) -> list[str]:
    """Columns that xxhash64 takes."""
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine (master local) gets a temporary folder; on a cluster
    it is an error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine: the next stage's workers share an executor with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by written()."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark._jvm
    for p in paths:
        if "part-" not in p:
            hp = jvm.org.apache.hadoop.fs.Path(p)
            hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)
