"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines of a document is a window. A window whose
three lines occur more than once in the table keeps its first occurrence (by
doc_id, nulls first, then position); the lines that later occurrences cover are
removed, overlapping ones merged into one stretch.

Defined results
- null text: kept as null, no lines, nothing removed; empty text: one empty line, kept.
- fewer than three lines: no window, text unchanged.
- windows of blank lines only (white space of any kind, so CR LF files too) never count.
- a later occurrence that overlaps the first one in the same document leaves the
  lines of the first in place.
- rows that repeat doc_id and text count as one document: all get the same result,
  so none is a later occurrence of another. Rows that share doc_id but not text are
  ordered by a hash of the text.
- further columns of the input are carried along, but for those with the names of results
  (n_lines, n_removed, removed_lines; a prefix gives the results other names); internal
  columns start with "__".
- an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import carried, table

WINDOW = 3


def _lines(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__lines", F.split(F.col(text), "\n"))


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: document key, position of its first line, 128-bit hash of its lines."""
    base = _lines(
        docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("__dk")), "__text"
    ).where(F.size("__lines") >= WINDOW)
    line = lambda i, k: F.get(F.col("__lines"), i + k)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__lines") - WINDOW),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(line(i, 0), line(i, 1), line(i, 2)).alias("k1"),
            F.xxhash64(F.lit("second"), line(i, 2), line(i, 1), line(i, 0)).alias("k2"),
            F.concat(line(i, 0), line(i, 1), line(i, 2)).rlike(r"[^\x20\x09-\x0D]").alias("real"),
        ),
    )
    return (
        base.select("__id", "__dk", F.explode(windows).alias("w"))
        .where("w.real")
        .select("__id", "__dk", F.col("w.pos").alias("__pos"), F.col("w.k1").alias("__k1"), F.col("w.k2").alias("__k2"))
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """docs with text cleaned, plus n_lines, n_removed (int) and removed_lines, the removed line numbers (from 0); prefix goes before these names."""
    names = [prefix + n for n in ("n_lines", "n_removed", "removed_lines")]
    docs = docs.select(*carried(docs, tuple(names)))
    windows = line_windows(docs, doc_id, text)
    first = (
        windows.groupBy("__k1", "__k2")
        .agg(F.min(F.struct("__id", "__dk", "__pos")).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select("__k1", "__k2", "__first")
    )
    same_doc = F.col("__id").eqNullSafe(F.col("__first.__id")) & (F.col("__dk") == F.col("__first.__dk"))
    covered = (
        windows.join(first, ["__k1", "__k2"])
        .where(~(same_doc & (F.col("__pos") == F.col("__first.__pos"))))
        .select(
            "__id",
            "__dk",
            F.when(same_doc, F.greatest(F.col("__pos"), F.col("__first.__pos") + WINDOW)).otherwise(F.col("__pos")).alias("__from"),
            (F.col("__pos") + (WINDOW - 1)).alias("__to"),
        )
        .groupBy("__id", "__dk")
        .agg(F.collect_set(F.struct("__from", "__to")).alias("__spans"))
        .select(
            F.col("__id").alias("__cid"),
            F.col("__dk").alias("__cdk"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["__from"], s["__to"]))))).alias("__cut"),
        )
    )
    keyed = docs.withColumn("__dk", F.xxhash64(F.col(doc_id), F.col(text)))
    joined = keyed.join(covered, F.col(doc_id).eqNullSafe(F.col("__cid")) & (F.col("__dk") == F.col("__cdk")), "left")
    parts = _lines(joined, text).withColumns(
        {
            "__n": F.coalesce(F.size("__lines"), F.lit(0)),
            "__left": F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__cut", F.array().cast("array<int>"))),
        }
    )
    kept = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(F.transform("__left", lambda i: F.get(F.col("__lines"), i)), "\n"))
    return parts.select(
        *[kept.alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).alias(names[0]),
        F.coalesce(F.size("__cut"), F.lit(0)).alias(names[1]),
        F.coalesce("__cut", F.array().cast("array<int>")).alias(names[2]),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that repeat an earlier three-line window removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", F.col("n_removed").alias("n_removed"))


ORACLE = {
    "op3_line_dedup": """
with l as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (
  select doc_id, p::bigint as p, ls[p] as a, ls[p+1] as b, ls[p+2] as c
  from (select doc_id, ls, unnest(range(1, len(ls) - 1)) as p from l)),
g as (
  select a, b, c, min(struct_pack(d := doc_id, p := p)) as f from w
  where regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]') group by a, b, c having count(*) > 1),
cut as (
  select distinct w.doc_id, unnest(range(
    case when w.doc_id = g.f.d then greatest(w.p, g.f.p + 3) else w.p end, w.p + 3)) as i
  from w join g using (a, b, c) where not (w.doc_id = g.f.d and w.p = g.f.p)),
lines as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from l),
kept as (
  select lines.doc_id, string_agg(lines.line, chr(10) order by lines.i) filter (where cut.i is null) as t,
         count(*) as n, count(cut.i) as r
  from lines left join cut on lines.doc_id = cut.doc_id and lines.i = cut.i group by lines.doc_id)
select l.doc_id, case when l.text is null then null else coalesce(kept.t, '') end as text,
       coalesce(kept.n, 0)::integer as n_lines, coalesce(kept.r, 0)::integer as n_removed
from l left join kept on l.doc_id = kept.doc_id
""",
}
QUERIES = {"op3_line_dedup": op3_line_dedup}
