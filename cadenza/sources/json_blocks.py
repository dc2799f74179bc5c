"""The objects of an array inside one large JSON document, found in many tasks.

`{"metadata": {...}, "samples": [{...}, {...}, ...]}` is one value, so Spark's JSON reader gives it to
one task. Here the text source cuts the file after every closing brace, split by split. Whether a piece starts
inside a string is the parity of the quotes before it, and its depth the sum of braces outside of
strings before it: both are running sums, taken inside a split and over the splits' totals. Pieces between two
returns to depth 1 are one object, in their order; the array's are those from its name on to the next name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.common import settled

STRING = r'"(?:[^"\\]++|\\.)*+"'
#: Up to the next brace outside of a string.
LEAD = rf'(?s)^(?:[^"{{]++|{STRING})*+'


def _ahead(pieces: DataFrame, value: Column, out: str) -> DataFrame:
    """pieces with the sum of value over all pieces before."""
    valued = settled(pieces.withColumn("__v", value))
    blocks = valued.groupBy("block").agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = settled(blocks.select(F.col("block").alias("__block"), before.alias("__before")))  # a row a split of the file
    inside = F.coalesce(F.sum("__v").over(W.partitionBy("block").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return valued.join(F.broadcast(blocks), F.col("block") == F.col("__block")).withColumn(out, F.col("__before") + inside).drop("__v", "__block", "__before")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def array_objects(spark: SparkSession, path: str, field: str, schema: str, whole: bool = True) -> DataFrame:
    """ord (from 0, in file order) and value (of the schema) of the objects of the array `field` at the top of the document.

    A document that ends early is an error with whole. A missing or empty array gives no rows; elements that are no objects are left out.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes; they stand in strings only
    pieces = _ahead(text.withColumn("plain", plain), _count(F.col("plain"), '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), F.col("plain"))).otherwise(F.col("plain")), r'(?s)"[^"]*("|$)', "")
    ends = (F.col("quotes") + _count(F.col("plain"), '"')) % 2 == 0  # the brace after the piece closes an object
    pieces = pieces.withColumns({"turn": _count(outside, "{") - F.when(ends, 1).otherwise(0), "closes": ends}).drop("plain")
    pieces = _ahead(pieces, F.col("turn"), "depth")
    if whole:
        left, odd = pieces.agg(F.coalesce(F.sum("turn"), F.lit(0)), F.coalesce(F.sum(_count(F.regexp_replace("value", r"(?s)\\.", ""), '"')) % 2, F.lit(0))).first()
        if left not in (0, -1) or odd:  # -1: blanks after the last brace count as a piece
            raise ValueError(f"{path} does not hold one whole JSON object")
    back = F.col("closes") & (F.col("depth") + F.col("turn") == 1)
    pieces = _ahead(pieces, F.when(back, 1).otherwise(0), "number").where(F.col("depth") + F.col("turn") >= 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "i", "value", "depth"))), lambda p: F.struct(p["value"].alias("value"), p["depth"].alias("depth")))
    objects = pieces.groupBy("number").agg(parts.alias("p"), F.max(back).alias("done")).where("done")
    joined = F.concat(F.array_join(F.transform("p", lambda p: p["value"]), "}"), F.lit("}"))
    objects = objects.select("number", joined.alias("text"), F.get("p", F.lit(0))["depth"].alias("depth"))
    root = F.when(F.col("depth") == 0, F.regexp_extract("text", LEAD + r"\{", 0)).otherwise("")
    rest = F.expr("substring(text, length(root) + 1)")
    lead = F.regexp_extract("rest", LEAD, 0)
    name = F.regexp_extract("lead", rf'(?s)({STRING})\s*:\s*\[?\s*$', 1)
    objects = settled(objects.withColumn("root", root).withColumn("rest", rest).withColumn("lead", lead).select("number", F.when(name != "", F.from_json(F.concat(F.lit('{"n":'), name, F.lit("}")), "n string")["n"]).alias("name"), F.expr("substring(rest, length(lead) + 1)").alias("text")))
    first = objects.where(F.col("name") == field).agg(F.min("number")).first()[0]
    stop = None if first is None else objects.where((F.col("number") > first) & F.col("name").isNotNull()).agg(F.min("number")).first()[0]
    mine = objects.where(F.lit(False) if first is None else (F.col("number") >= first) & (F.lit(True) if stop is None else F.col("number") < stop))
    return mine.select((F.col("number") - F.lit(first or 0)).alias("ord"), F.from_json("text", schema).alias("value"))
