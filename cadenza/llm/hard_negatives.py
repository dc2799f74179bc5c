"""Hard negatives: rows of another label that score just below an anchor's positives.

Vectors become whole numbers, floor(scale * x), so that scores (inner products) are exact integers:
products whose sums stay below 2^53 go through float64 matrix products, larger ones through
int64 or Python's integers. Rows are dealt evenly to shards, anchors to blocks, and every block
meets every shard once in each of two passes, in the task that the shard's number is dealt to:

1. Each anchor's positives: the first of its label by score and id, of each shard, then of all.
2. Each anchor's scores against a shard's rows of other labels are sorted whole (by score, largest
   first, then id); each positive's upper limit is found in them by binary search, and the first k
   entries from there on that reach the lower limit are read. The first k of all shards stay.

A task holds one shard and one block, whatever the table's size and the anchors' number; nothing
is dealt by label or id, so hot labels and repeated ids do no harm. What shards send is k rows for
each anchor and positive.

Defined results: rows take no part whose id or label is null, whose vector is null or has a null
or non-finite component, or one that is not finite times the scale. A row meets rows with as many
components as it has. Others are rows with another id; rows that repeat are rows of their own
(as anchors, too: each gives its own result). An anchor without positives, or a positive without
negatives within the limits, has no rows. A score that does not fit a long is an error. An empty table gives none. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import table, written

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score is between LEAST_SHARE percent of the positive's score and all of it.
LEAST_SHARE = 80
#: Rows of a shard, anchors of a block, and most partitions that either is dealt to (then a partition makes several).
ROWS, ANCHORS, PARTS = 8192, 256, 20_000
PACKED = "part int, dims int, n int, ids binary, labels binary, vectors binary"
_PACKED_NAMES = ["part", "dims", "n", "ids", "labels", "vectors"]


def usable(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the vectors of each length that have finite components only."""
    flat = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for dims in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dims)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * flat[start[at][:, None] + np.arange(dims)])
        good = np.isfinite(x).all(axis=1)
        yield at[good], x[good]


def packed(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """rows(id, vector, label), without nulls in id and label, as rows of up to `most` vectors of one length, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_ = TaskContext.get().partitionId(), {}

        def close(dims: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(p) for p in zip(*open_.pop(dims)))
            order = np.argsort(ids, kind="stable")
            body = [ids[order].tobytes(), labels[order].tobytes(), x[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (part, dims, len(ids))] + [pa.array([b], pa.binary()) for b in body], names=_PACKED_NAMES)

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at, x in usable(batch.column(1), scale):
                dims = x.shape[1]
                while len(at):
                    room = most - sum(len(i) for i, _, _ in open_.get(dims, []))
                    open_.setdefault(dims, []).append((ids[at[:room]], labels[at[:room]], x[:room]))
                    if len(at) >= room:
                        yield close(dims)
                    at, x = at[room:], x[room:]
        for dims in list(open_):
            yield close(dims)

    return rows.mapInArrow(run, PACKED)


class Cell:
    """Anchors of a block against the rows of a shard."""

    def __init__(self, block: dict, shard: dict) -> None:
        self.anchor_ids, self.anchor_labels, a = self._open(block)
        self.ids, self.labels, x = self._open(shard)
        dims = a.shape[1]
        bound = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * dims
        if bound < 1 << 53:
            self.scores = (a @ x.T).astype(np.int64)
        elif bound < 1 << 63:
            self.scores = a.astype(np.int64) @ x.astype(np.int64).T
        else:
            whole = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in x], object).T
            if any(abs(v) >= 1 << 63 for v in whole.flat):
                raise ArithmeticError("a score does not fit a long")
            self.scores = whole.astype(np.int64)

    @staticmethod
    def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])

    def sorted(self, i: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores, largest first, and ids, of the shard's other rows with the label of anchor i, or of its rows with another label."""
        at = np.flatnonzero((self.labels == self.anchor_labels[i]) & (self.ids != self.anchor_ids[i]) if same else self.labels != self.anchor_labels[i])
        score, ids = self.scores[i, at], self.ids[at]
        order = np.lexsort((ids, -score))
        return score[order], ids[order]


def within(scores: np.ndarray, positive: int, k: int, share: int) -> slice:
    """The first k of scores, largest first, from positive down to share percent of it."""
    first = int(np.searchsorted(-scores, -positive, "left"))
    least = -(-share * positive // 100)
    return slice(first, first + int((scores[first : first + k] >= least).sum()))


def _meeting(blocks: DataFrame, shards: DataFrame, parts: int) -> DataFrame:
    """Shards and a copy of every block for each part, a part's rows in one task: its shards first, then blocks one by one.

    No join, so no plan can broadcast the copies, whose number it does not know, and no shard is repeated for each block.
    """
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # blocks are copied, shards stay; shards hold ROWS / ANCHORS times as much
    alone = shards.withColumns({c: F.lit(None).cast(copies.schema[c].dataType) for c in blocks.columns if c not in shards.columns})
    return copies.unionByName(alone).repartition("part").sortWithinPartitions("part", F.col("block").isNotNull())


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Cell]]:
    """(block, cell) of every block and the shards of its part with vectors as long, from rows of _meeting()."""
    part, shards = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if row["part"] != part:
                part, shards = row["part"], []
            if row["block"] is None:
                shards.append(row)
                continue
            for shard in shards:
                if shard["dims"] == row["dims"]:
                    yield row, Cell(row, shard)


def _table(parts: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = LEAST_SHARE, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which `anchors` holds."""
    known = rows.select(rows[vec_id].cast("long").alias("id"), rows[embedding].alias("vector"), rows[label].cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks")).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    total, asking = known.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    parts, deals = (max(1, min(PARTS, -(-n // most))) for n, most in ((total, ROWS), (asking, ANCHORS)))
    shards = written(packed(known.select("id", "vector", "label").repartition(parts), ROWS, scale), "shards")
    blocks = packed(known.where("asks").select("id", "vector", "label").repartition(deals), ANCHORS, scale)
    blocks = written(blocks.drop("part").withColumn("block", F.monotonically_increasing_id()), "blocks")
    first = ["block", "at", "anchor_id", "id", "score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, cell in _opened(batches):
            found = []
            for i, anchor in enumerate(cell.anchor_ids.tolist()):
                score, ids = (x[:positives] for x in cell.sorted(i, same=True))
                found.append((*(np.full(len(ids), v, np.int64) for v in (row["block"], i, anchor)), ids, score))
            yield _table(found, first, [pa.int64()] * 5)

    of_anchor = W.partitionBy("block", "at").orderBy(F.desc("score"), "id")
    top = _meeting(blocks, shards, parts).mapInArrow(best, "block long, at long, anchor_id long, id long, score long")
    top = written(top.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives), "positives")
    # of a block ANCHORS anchors and their positives at most
    limits = top.groupBy("block").agg(F.collect_set(F.struct("at", "score")).alias("limits"))
    second = ["block", "at", "score", "negative_id", "negative_score"]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, cell in _opened(batches):
            found, wanted = [], {}
            for x in row["limits"]:
                wanted.setdefault(x["at"], []).append(x["score"])
            for i, scores in wanted.items():
                score, ids = cell.sorted(i, same=False)
                for positive in scores:
                    some = within(score, positive, negatives, share)
                    n = some.stop - some.start
                    found.append((*(np.full(n, v, np.int64) for v in (row["block"], i, positive)), ids[some], score[some]))
            yield _table(found, second, [pa.int64()] * 5)

    of_positive = W.partitionBy("block", "at", "score").orderBy(F.desc("negative_score"), "negative_id")
    low = _meeting(blocks.hint("merge").join(limits, "block"), shards, parts).mapInArrow(below, "block long, at long, score long, negative_id long, negative_score long")
    low = low.withColumn("rank", F.row_number().over(of_positive)).where(F.col("rank") <= negatives)
    out = top.hint("merge").join(low, ["block", "at", "score"])  # merge hints: both sides grow with the anchors, and the driver would build what is broadcast
    return out.select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every row whose id is divisible by 100, over all rows; labels of every seventh id are moved on by one first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {
    "op13_hard_negatives": """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from e a join e r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select * from s where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and s.label <> p.anchor_label and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 5""",
}
