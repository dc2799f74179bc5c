"""Helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most; larger ones are dealt out by a salted key.
SMALL, SALTS = 10_000, 32
#: Rows from which a key is dealt out in spread().
MANY = 200_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where nulls match; the right side's keys are not repeated. No keys: right must be one row, more are an error."""
    if not keys:
        alone = F.assert_true(F.count(F.lit(1)).over(W.partitionBy()) == 1, "a join without keys needs one row on its right")
        return left.crossJoin(F.broadcast(right.withColumn("__alone", alone).where("__alone IS NULL").drop("__alone")))
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"__right_{k}" for k in keys])


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder that driver and executors share; further reads find the same rows.

    The folder is spark.checkpoint.dir; where that is unset, one machine (master local) takes a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return df.checkpoint()


def meet(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """join_on with a settled table of few rows a key: broadcast if it is small, else with each row of df at one of SALTS copies, as a key may be hot."""
    if table.count() <= SMALL:
        return join_on(df, F.broadcast(table), keys, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(SALTS)))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return join_on(salted, copies, [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """join_on with a table of one row a key and of any size: rows of a key that has over MANY of them meet SALTS copies of its row."""
    hot = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__many")).where(F.col("__many") > MANY).drop("__many"))
    if hot.isEmpty():
        return join_on(df, table, keys, how)
    marked = hot.withColumn("__hot", F.lit(True))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("__hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long")))
    left, right = meet(df, marked, keys, "left").withColumn("__salt", salt).drop("__hot"), meet(table, marked, keys, "left").withColumn("__salt", copies).drop("__hot")
    return join_on(left, right, [*keys, "__salt"], how).drop("__salt")
