"""Near-duplicate documents by ProbMinHash over weighted word shingles.

1. Documents with equal texts form one node (a hash of the text), so groups of copies
   cost one signature.
2. A node's shingles are its runs of five words, weighted by how often they occur. Each
   shingle is a Poisson process whose rate is its weight; arrivals fall on a register at
   random, the earliest of a register wins it, and a shingle stops once its next arrival
   comes after the latest time of any register (ProbMinHash1: Ertl, 2020). Two nodes agree
   on a register with their probability Jaccard similarity.
3. Bands of registers are hashed; nodes that share a bucket are candidates. In the first
   bands all members of a bucket meet its most connected one, which joins most of a large
   group. Then only buckets whose members are not one component by now go on, and every pair
   of their members from different components is compared, except pairs inside the bucket's
   leading component. Small buckets are expanded into pairs. The members of larger ones are
   not: two texts of the wanted similarity have that share of either's shingles in common, so
   they share one of the rarest few of each (prefix filtering, exact). Members meet by these
   rare shingles instead, in groups that go on only if they hold several components. Texts
   that are alike by one common passage do not meet there, as what else they hold is rare.
   Small groups are expanded into pairs; larger ones are cut into blocks of bounded rows and
   characters, and two blocks meet in a cell, which compares all its pairs in matrix form and
   returns links that join something.
4. Candidates are verified by the exact probability Jaccard of their texts (0.8 or more), and
   verified links are closed into components by label propagation with pointer jumping.

Defined results: texts of one to four words have one shingle, all their words; null and
blank texts are classes of their own; rows that repeat a doc_id are documents of their own
that stay or go together if they share the text too; a class is named by its smallest
doc_id (null if it has none). Words are split at white space and compared as they stand.
Texts of any length are read whole (in a cell a text beyond BLOCK_CHARS is a block of its
own); an empty table has no rows; columns other than id and text play no part in
near_duplicates, and keep_one carries all of them along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import dropped, hashable, table, tidy, written

SHINGLE, SIMILARITY, BANDS, ROWS, FIRST_BANDS = 5, 0.8, 32, 6, 3
#: Buckets and groups of up to so many nodes are expanded into pairs; larger groups are cut into blocks of up to so many nodes and characters.
PAIRWISE, BLOCK_ROWS, BLOCK_CHARS = 16, 512, 2_000_000
#: Counters for how often shingles occur.
COUNTERS = 1 << 20
#: Columns of the dense pieces in which a cell counts common shingles.
PIECE = 8192
#: Rounding allowed for in sums that are compared with the similarity.
ROUNDING = 1e-9
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
_BASE = 0xD6E8FEB86659FD93
#: Powers of _BASE and of its inverse modulo 2^64, grown to the longest text seen, up to POWERS places.
POWERS = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    size = 1 << (n - 1).bit_length()
    grown = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        grown.append(np.cumprod(steps))
    if size <= POWERS:
        _powers[:] = grown
    return grown


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every white-space separated word, from a running polynomial over the characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _SPACES[np.minimum(codes, 0x3001)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[0::2], edges[1::2]
    power, inverse = _powers_up_to(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * power[: len(codes)], out=total[1:])
    return _mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _GOLD)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their weights."""
    h = word_hashes(text or "")
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0)
    width = min(SHINGLE, len(h))
    x = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        x = _mix(x + _GOLD) ^ h[k : k + len(x)]
    ids, weights = np.unique(_mix(x), return_counts=True)
    return ids, weights.astype(np.float64)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash1 signatures (documents, registers) as uint32; documents without shingles get zeros."""
    out = np.zeros((len(docs), registers), np.uint32)
    order = sorted((i for i, d in enumerate(docs) if len(d[0])), key=lambda i: len(docs[i][0]))
    at = 0
    while at < len(order):
        # documents of like size go together; small ones take several arrivals of a shingle at a time
        burst = max(1, min(64, 4 * registers // len(docs[order[at]][0])))
        part, n = [], 0
        while at < len(order) and (not part or (n + len(docs[order[at]][0])) * burst <= 400_000 and len(part) < 1000):
            part.append(order[at])
            n += len(docs[order[at]][0])
            at += 1
        out[part] = _race([docs[i] for i in part], registers, burst)
    return out


def _race(docs: list[tuple[np.ndarray, np.ndarray]], m: int, burst: int) -> np.ndarray:
    ids = np.concatenate([d[0] for d in docs])
    rate = np.concatenate([d[1] for d in docs])
    of = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    time, first = np.zeros(len(ids)), np.full(len(docs) * m, np.inf)
    won = np.zeros(len(docs) * m, np.uint32)
    count = 0
    while len(ids):
        steps = np.arange(count, count + burst, dtype=np.uint64) + np.uint64(1)
        r = _mix(ids[:, None] + steps * _GOLD)
        times = time[:, None] + np.cumsum(-np.log1p(-((r >> np.uint64(11)) * 2.0**-53)), axis=1) / rate[:, None]
        place = of[:, None] * m + ((_mix(r) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        early = times < first[place]
        t, p = times[early], place[early]
        late_first = np.argsort(-t, kind="stable")  # of several arrivals at a register the earliest is written last
        first[p[late_first]] = t[late_first]
        won[p[late_first]] = (np.broadcast_to(ids[:, None], early.shape)[early] >> np.uint64(32)).astype(np.uint32)[late_first]
        time, count = times[:, -1], count + burst
        open_ = time < first.reshape(-1, m).max(axis=1)[of]
        ids, rate, of, time = ids[open_], rate[open_], of[open_], time[open_]
    return won.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    x = np.broadcast_to(_mix(np.arange(bands, dtype=np.uint64) + _GOLD), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        x = _mix(x + _GOLD) ^ _mix(rows[:, :, k] + _GOLD)
    return _mix(x).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity: sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a[0])], y[np.searchsorted(ids, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    last = np.searchsorted(ratio, ratio, side="right")
    low = np.append(0.0, np.cumsum(x))[last]
    high = y.sum() - np.append(0.0, np.cumsum(y))[last]
    both = (x > 0) & (y > 0)
    return float((x[both] / (low[both] + high[both] / ratio[both])).sum())


# -- Spark ---------------------------------------------------------------------------
def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (binary), blank, bands array<long> and chars of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nodes, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                once = {n: t for n, t in zip(nodes, texts) if t and not t.isspace()}
                place = {n: i for i, n in enumerate(once)}
                keys = band_keys(signatures([shingles(t) for t in once.values()])).tolist() if once else []
                bands = [keys[place[n]] if n in place else None for n in nodes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b is None for b in bands]), pa.array(bands, pa.list_(pa.int64())), pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "node", "blank", "bands", "chars"])
            tidy()

    return docs.select("doc_id", node(F.col("text")).alias("node"), "text").mapInArrow(run, f"doc_id {kind}, node binary, blank boolean, bands array<long>, chars long")


def node(text):  # noqa: ANN001, ANN201
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs(a, b) with their exact similarity."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def known(text: str) -> tuple[np.ndarray, np.ndarray]:
            return shingles(text)

        for batch in batches:
            sims = [probability_jaccard(known(x), known(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a binary, b binary, similarity double").withColumn("linked", F.col("similarity") >= similarity - ROUNDING)


def _common(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the common shingles for all pairs of left and right: by the left one's weights, by the right one's."""
    ids = np.concatenate([d[0] for d in left + right])
    weight = np.concatenate([d[1] for d in left + right])
    of = np.repeat(np.arange(len(left) + len(right)), [len(d[0]) for d in left + right])
    order = np.argsort(ids, kind="stable")
    ids, weight, of = ids[order], weight[order], of[order]
    new = np.append(True, ids[1:] != ids[:-1])
    again = ~(new & np.append(new[1:], True))  # shingles of one text only are common to no pair
    column, weight, of = np.cumsum(new[again]) - 1, weight[again], of[again]
    x = np.zeros((len(left), len(right)), np.float32)
    y = x.copy() if (weight != 1).any() else x
    ends = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + PIECE, PIECE))
    for lo, hi in zip(ends, ends[1:]):
        dense = np.zeros((len(left) + len(right), PIECE), np.float32)
        dense[of[lo:hi], column[lo:hi] % PIECE] = weight[lo:hi]
        a, b = dense[: len(left)], dense[len(left) :]
        x += a @ (b > 0).astype(np.float32).T
        if y is not x:
            y += (a > 0).astype(np.float32) @ b.T
    return x, y


def cell_links(within: bool, label: np.ndarray, first: np.ndarray, texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """Pairs of a cell's members that are similar and join different labels, without those that close a circle.

    first marks the members of the cell's first block; within: it has no other.
    """
    left, right = np.flatnonzero(first), np.flatnonzero(first if within else ~first)
    asked = label[left][:, None] != label[right][None, :]
    if within:
        asked &= left[:, None] < right[None, :]
    left, asked = left[asked.any(axis=1)], asked[asked.any(axis=1)]
    right, asked = right[asked.any(axis=0)], asked[:, asked.any(axis=0)]
    if not asked.size:
        return []
    known = {i: shingles(texts[i]) for i in {*left.tolist(), *right.tolist()}}
    lefts, rights = [known[i] for i in left.tolist()], [known[i] for i in right.tolist()]
    x, y = _common(lefts, rights)
    total_x, total_y = np.array([d[1].sum() for d in lefts])[:, None], np.array([d[1].sum() for d in rights])[None, :]
    flat_x, flat_y = np.array([(d[1] == 1).all() for d in lefts]), np.array([(d[1] == 1).all() for d in rights])
    # the common share of either text bounds the similarity; without repeated shingles it is the plain Jaccard similarity
    asked &= np.minimum(x / total_x, y / total_y) >= similarity - ROUNDING
    flat = flat_x[:, None] & flat_y[None, :]
    linked = asked & flat & (x / (total_x + total_y - x) >= similarity - ROUNDING)
    for i, j in np.argwhere(asked & ~flat).tolist():
        linked[i, j] = probability_jaccard(lefts[i], rights[j]) >= similarity - ROUNDING
    up = list(range(int(label.max()) + 1))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    out = []
    for i, j in np.argwhere(linked).tolist():
        a, b = top(label[left[i]]), top(label[right[j]])
        if a != b:
            up[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def _counter(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(20)).astype(np.int64) % COUNTERS


def _rare_groups(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Members(node, label, chars) by the rare shingles that pairs of them would share: band, node, label, rest, n, chars (both of the group).

    A member's shingles, the rarest among all members first, up to a share of 1 - similarity of their
    weight before them: what similar texts have in common cannot lie behind these alone. Any order of
    the shingles that is the same for all members would do; how often they occur is counted in a table
    of fixed size, by a part of their hash. Groups of one label are left out.
    """
    spark = members.sparkSession
    each = members.select("node").join(texts, "node").select("node", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                np.add.at(total, _counter(shingles(text)[0]), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["counter", "n"])

    counted = each.mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    table = np.zeros(COUNTERS, np.int64)
    table[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, tokens = batch.column(0).to_pylist(), []
            for text in batch.column(1).to_pylist():
                ids, weight = shingles(text)
                often = shared.value[_counter(ids)]
                order = np.lexsort((ids, often))
                ids, weight, often = ids[order], weight[order], often[order]
                ahead = np.cumsum(weight) - weight
                tokens.append(ids[(ahead <= (1 - similarity + ROUNDING) * weight.sum()) & (often > 1)].view(np.int64))
            take = pa.array(np.repeat(np.arange(len(nodes)), [len(t) for t in tokens]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()).take(take), pa.array(np.concatenate(tokens or [np.zeros(0, np.int64)]))], names=["node", "band"])

    rare = each.mapInArrow(run, "node binary, band long")
    sizes = written(members.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label-sizes")
    known = members.join(sizes, "label").select("node", "label", "chars", "size")
    rare = written(rare.join(known, "node"), "rare")
    top = F.max(F.struct("size", "label"))
    groups = rare.groupBy("band").agg(top.alias("top"), (F.min("label") != F.max("label")).alias("open"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all")).where("open")
    groups = written(groups.select(F.col("band").alias("g"), F.col("top.label").alias("main"), "n", "all"), "groups")
    placed = written(rare.join(groups, F.col("band") == F.col("g")).select("band", "node", "label", (F.col("label") != F.col("main")).alias("rest"), "n", F.col("all").alias("chars")), "rare-groups")
    for old in (rare, groups, sizes):
        dropped(spark, old)
    return placed


def _block_links(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of the large groups in placed(band, node, label, rest, n, chars)."""
    open_ = placed.groupBy("band").agg(F.sum(F.col("rest").cast("long")).alias("r")).withColumnRenamed("band", "ob")
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CHARS) * F.col("n") / F.greatest(F.col("chars"), F.lit(1)))))
    cut = placed.join(open_, F.col("band") == F.col("ob")).withColumn("per", per).withColumn("kr", F.ceil(F.col("r") / F.col("per")).cast("int")).withColumn("km", F.ceil((F.col("n") - F.col("r")) / F.col("per")).cast("int"))
    spread = F.xxhash64("node", "band")
    cut = cut.withColumn("block", F.when(F.col("rest"), F.pmod(spread, F.col("kr"))).otherwise(F.col("kr") + F.pmod(spread, F.greatest(F.col("km"), F.lit(1)))).cast("int"))
    last = F.when(F.col("rest"), F.col("kr") + F.col("km") - 1).otherwise(F.col("kr") - 1)
    cells = cut.select("band", "node", "label", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cells = cells.join(texts, "node").select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "label", "block", "text")

    def run(cell: pa.Table) -> pa.Table:
        lo, hi = (cell.column(c)[0].as_py() for c in ("lo", "hi"))
        label = np.unique(np.array([v.hex() for v in cell.column("label").to_pylist()]), return_inverse=True)[1]
        nodes = cell.column("node").to_pylist()
        found = cell_links(lo == hi, label, cell.column("block").to_numpy() == lo, cell.column("text").to_pylist(), similarity)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return cells.groupBy("band", "lo", "hi").applyInArrow(run, "a binary, b binary")


def components(edges: DataFrame, complete: bool = True, start: DataFrame | None = None) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of edges(a, b).

    Not complete: one step only; nodes of one label are connected then, but a component may have several labels.
    start: labels (node, label) of such a step, over some of the edges.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    if start is not None:
        labels = labels.join(start.withColumnRenamed("label", "known"), "node", "left").select("node", F.least("label", "known").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(step.join(jump, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        moved = complete and new.where("label != old").limit(1).count()
        dropped(spark, labels)
        labels = new.select("node", "label")
        if not moved:
            dropped(spark, both)
            return labels


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, node (binary hash of the text), label (binary, the smallest node of its class; null for blank texts). A table in the shared folder."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = written(_signed(plain), "signed")
    nodes = signed.where("NOT blank").groupBy("node").agg(F.min(F.struct("doc_id", "bands", "chars")).alias("r")).select("node", "r.doc_id", "r.bands", "r.chars")
    nodes = written(nodes, "nodes")
    entries = nodes.select("node", "chars", F.posexplode("bands").alias("place", "band"))
    shared = written(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = entries.join(shared, "band").select("band", "place", "node", "chars", "n")
    ranked = written(members.withColumn("degree", F.sum("n").over(W.partitionBy("node"))), "ranked")  # a node has a row for each band at most
    dropped(spark, shared)
    # one text for each node that has company
    wanted = ranked.select("node").distinct().join(nodes.select("node", "doc_id"), "node").withColumnsRenamed({"node": "wn", "doc_id": "wd"})
    texts = plain.withColumn("node", node(F.col("text"))).join(wanted, (F.col("node") == F.col("wn")) & F.col("doc_id").eqNullSafe(F.col("wd"))).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")

    def pair(x, y):  # noqa: ANN001, ANN202
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    # a first round over a few bands joins most of a large group, so that the other bands meet few open pairs
    few = ranked.where(F.col("place") < FIRST_BANDS)
    leader = few.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("leader"))
    pairs = few.join(leader, "band").where("node != leader").select(*pair(F.col("node"), F.col("leader"))).distinct()
    tested = written(_verified(pairs, texts, similarity), "tested")
    labels = components(tested.where("linked"), complete=False)
    placed = ranked.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lead = placed.groupBy("band").agg(F.max(F.struct("degree", "node", "label")).alias("top"), (F.min("label") != F.max("label")).alias("open")).where("open").select("band", F.col("top.label").alias("main"))
    placed = written(placed.join(lead, "band").withColumn("rest", F.col("label") != F.col("main")), "placed")
    big = written(placed.where(F.col("n") > PAIRWISE).groupBy("node", "label").agg(F.max("chars").alias("chars")), "big")
    groups = _rare_groups(big, texts, similarity)

    def small_pairs(groups: DataFrame) -> DataFrame:
        small = groups.where(F.col("n") <= PAIRWISE)
        x = small.where("rest").select("band", F.col("node").alias("x"), F.col("label").alias("lx"))
        return x.join(small.select("band", F.col("node").alias("y"), F.col("label").alias("ly")), "band").where("lx != ly").select(*pair(F.col("x"), F.col("y")))

    pairs = small_pairs(placed).union(small_pairs(groups)).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    links = tested.where("linked").select("a", "b").union(_verified(pairs, texts, similarity).where("linked").select("a", "b"))
    links = written(links.union(_block_links(groups.where(F.col("n") > PAIRWISE), texts, similarity)), "links")
    dropped(spark, big)
    dropped(spark, groups)
    dropped(spark, placed)
    labels = components(links, start=labels)
    for old in (ranked, texts, tested, links, nodes):
        dropped(spark, old)
    found = signed.select("doc_id", "node", "blank").join(labels, "node", "left").withColumn("label", F.when(~F.col("blank"), F.coalesce("label", "node")))
    return written(found.drop("blank"), "found")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, node, label (see labelled), class_id and class_size (documents)."""
    found = labelled(docs, doc_id, text, similarity)
    # a table of its own: both sides of the join are plain exchanges then, and a hot class's rows can be dealt to several tasks
    classes = written(found.where("label IS NOT NULL").groupBy(F.col("label").alias("cl")).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    named = found.join(classes, F.col("label") == F.col("cl"), "left")
    blank = F.col("label").isNull()
    return named.select("doc_id", "node", "label", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(blank, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: of every near-duplicate class one row, and all blank texts.

    It is the row with the smallest doc_id (null last), of those the one with the smallest hash of
    the text; of rows that share both, the one with the smallest hash of all its columns.
    """
    found = labelled(docs, doc_id, text, similarity)
    # partial aggregation before each shuffle: a class, a text or an id with very many rows is one row of each task
    times = found.groupBy("label", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    first = times.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "n")).alias("f"))
    stay = first.select(F.col("f.doc_id").alias("__id"), F.col("f.node").alias("__node"), F.col("f.n").alias("__times"))
    blank = times.where("label IS NULL").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"), F.lit(1).cast("long").alias("__times"))
    stay = written(stay.union(blank), "stay")
    kept = docs.join(stay, F.col(doc_id).eqNullSafe(F.col("__id")) & (node(F.col(text)) == F.col("__node")))
    if stay.where("__times > 1").isEmpty():
        return kept.select(*[docs[c] for c in docs.columns])
    row = F.struct(*[docs[c] for c in docs.columns])
    again = kept.where("__times > 1").groupBy("__id", "__node").agg(F.min_by(row, F.xxhash64(*[docs[c] for c in hashable(docs)])).alias("__row"))
    return kept.where("__times = 1").select(*[docs[c] for c in docs.columns]).unionByName(again.select("__row.*"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size")


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLE: dict[str, str] = {}
