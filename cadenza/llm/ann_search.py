"""Approximate nearest neighbours with score-aware (anisotropic) quantisation.

The index splits unit vectors into cells by spherical k-means and stores every vector's
residual, in units of its cell's spread, in 4-bit codes, two dimensions a code. Codebooks and codes minimise the
anisotropic loss of Guo et al. (2020): the part of the error along the vector, which is
what a large inner product sees, weighs ETA times as much as the part across it. A
query scans the codes of its nearest cells with 16-entry tables, and the best few of every
block are ranked again by the exact cosine of the original vectors in double precision.

The first cells are fitted on at most SAMPLE distinct vectors, the codebooks on LEARN of them
(documented bounds, chosen by a seeded hash); the index holds every row. There are half as many cells as
the square root of the rows. Beyond FIRST_CELLS they come in two tiers: executors cut each
first cell by k-means over its part of a larger sample, in pieces of bounded size, as long as
all centres fit into CENTRE_BYTES (they are broadcast). How many cells a query visits is
measured: the least number that holds COVERED of the true neighbours, among all rows, of
PILOTS of the queries themselves, as queries may be spread quite unlike the rows. The exact
ranking goes on beyond the best few of a block until no entry's estimate, raised by the largest
error seen, could enter the result. Equal vectors are one entry that lists its smallest ids, as many as a
result can need, so groups of copies cost one entry and ties stay exact. Large cells are cut
into shards of bounded size, and the queries that visit a shard into batches; a shard is sent
to its own batches only. Nothing is dropped. A query goes on to further cells until they hold
LEAST_ENTRIES entries, or all.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, as rows without id; where lengths differ, the most frequent one counts (of
equally frequent ones the longest) and the others take no part. Rows that repeat id and
vector count once; a query never returns its own id. With fewer candidates than asked for,
all are returned; empty tables give no rows. Columns other than id and vector play no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import dropped, table, written

NEAREST, EVERY = 5, 50
SAMPLE, LEARN, ROUNDS, FIRST_CELLS, CENTRE_BYTES, PILOTS, COVERED, LEAST_ENTRIES, RERANK = 12_000, 6000, 6, 1024, 64_000_000, 256, 0.98, 200, 256
SHARD_ENTRIES, QUERY_BATCH, CODES, DIMS, THRESHOLD = 4096, 1024, 16, 2, 0.2
#: Second tier: sample vectors for each cell, most of them in a task, first cells that an assignment and a query look into.
CELL_SAMPLE, PIECE, ASSIGN, LOOK = 40, 20_000, 4, 64
#: Numbers of cells that a query may visit; all cells come last.
VISITS = tuple(sorted({int(1.2**k) for k in range(75)}))
#: Numbers in an intermediate array of the fit, the encoder or the probes.
BLOCK = 2_000_000


def k_means(x: np.ndarray, cells: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of spherical k-means over unit vectors."""
    centres = x[rng.choice(len(x), cells, replace=False)]
    step = max(1, BLOCK // cells)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


@dataclass
class Index:
    """Cells and codebooks: what a task needs to encode and to scan."""

    centres: np.ndarray  # (cells, dims)
    books: np.ndarray  # (subspaces, 16, 2)
    eta: float
    scales: np.ndarray  # (cells,): length of a usual residual, so that tight cells are coded as finely as wide ones
    first: np.ndarray | None = None  # centres of the first tier, if there are two
    starts: np.ndarray | None = None  # where the cells of each first cell begin, with the end
    visits: int = 1

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = levelled(x)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    @classmethod
    def fit(cls, vectors: np.ndarray, cells: int) -> Index:
        """One tier of cells; codebooks come with learn()."""
        x = cls.unit(vectors)
        dims = x.shape[1]
        cells = max(1, min(cells, len(x)))
        centres = k_means(x, cells, ROUNDS, np.random.default_rng(5))
        return cls(centres, np.zeros((-(-dims // DIMS), CODES, DIMS)), max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)), np.ones(cells))

    def tiers(self, centres: np.ndarray, of: np.ndarray) -> Index:
        """The index with a second tier; of: the first cell of each centre."""
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(self.centres) + 1))
        return Index(centres[order], self.books, self.eta, np.ones(len(centres)), self.centres, starts)

    def learn(self, vectors: np.ndarray) -> Index:
        """Scales and codebooks from a sample."""
        x, rng, cells = self.unit(vectors), np.random.default_rng(6), len(self.centres)
        near = self.assign(x)
        square = ((x - self.centres[near]) ** 2).sum(axis=1)
        held = np.bincount(near, minlength=cells)
        self.scales = np.sqrt(np.where(held > 1, np.bincount(near, square, cells) / np.maximum(held, 1), square.mean())) + 1e-9
        r, u = self._split(x[:LEARN], near[:LEARN])
        for s in range(len(self.books)):
            self.books[s] = r[rng.choice(len(r), CODES, replace=len(r) < CODES), s] + rng.normal(0, 1e-6, (CODES, DIMS))
        codes = self._codes(r, u, 1)
        for _ in range(ROUNDS):
            self._learn(r, u, codes)
            codes = self._codes(r, u, 1, codes)
        return self

    def likeness(self, x: np.ndarray, look: int) -> np.ndarray:
        """Products of unit vectors with the centres; with two tiers, with those of the nearest `look` first cells only."""
        if self.first is None:
            return x @ self.centres.T
        out = np.full((len(x), len(self.centres)), -np.inf)
        near = x @ self.first.T
        look = min(look, len(self.first))
        picked = np.argpartition(-near, look - 1, axis=1)[:, :look]
        for c in np.unique(picked).tolist():
            rows = np.flatnonzero((picked == c).any(axis=1))
            i, j = self.starts[c], self.starts[c + 1]
            out[rows, i:j] = x[rows] @ self.centres[i:j].T
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Cell of every unit vector."""
        step = max(1, BLOCK // len(self.centres))
        parts = [self.likeness(x[i : i + step], ASSIGN).argmax(axis=1) for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Cells by likeness to each vector, the nearest first."""
        return np.argsort(-self.likeness(self.unit(vectors), LOOK), axis=1, kind="stable")

    def least_visits(self, pilots: np.ndarray, cells: list[np.ndarray]) -> int:
        """Least number of visited cells that holds COVERED of the pilots' true neighbours; cells: theirs."""
        step, places = max(1, BLOCK // len(self.centres)), []
        for i in range(0, len(pilots), step):
            place = np.argsort(self.order(pilots[i : i + step]), axis=1)
            places += [row[c] for row, c in zip(place, cells[i : i + step])]
        places = np.concatenate(places) if places else np.zeros(0)
        fit = [n for n in VISITS if n < len(self.centres) and (places < n).mean() >= COVERED] if len(places) else []
        return fit[0] if fit else len(self.centres)

    def _split(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and unit vectors by subspace: (n, subspaces, 2)."""
        pad = self.books.shape[0] * DIMS - x.shape[1]
        shape = (len(x), self.books.shape[0], DIMS)
        return np.pad((x - self.centres[cell]) / self.scales[cell][:, None], ((0, 0), (0, pad))).reshape(shape), np.pad(x, ((0, 0), (0, pad))).reshape(shape)

    def _codes(self, r: np.ndarray, u: np.ndarray, sweeps: int, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes of least anisotropic loss, subspace by subspace, given those of the others."""
        step = max(1, BLOCK // (r.shape[1] * CODES * DIMS))
        parts = [self._block_codes(r[i : i + step], u[i : i + step], sweeps, None if codes is None else codes[i : i + step]) for i in range(0, len(r), step)]
        return np.concatenate(parts) if parts else np.zeros(r.shape[:2], np.int64)

    def _block_codes(self, r: np.ndarray, u: np.ndarray, sweeps: int, codes: np.ndarray | None) -> np.ndarray:
        n, subs, _ = r.shape
        # error and its part along the vector for every code: (n, subspaces, 16)
        err = r[:, :, None, :] - self.books[None]
        square, along = (err**2).sum(-1), (err * u[:, :, None, :]).sum(-1)
        codes = square.argmin(-1) if codes is None else codes.copy()
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for s in range(subs):
                rest = total - along[rows, s, codes[:, s]]
                codes[:, s] = (square[:, s] + (self.eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
                total = rest + along[rows, s, codes[:, s]]
        return codes

    def _learn(self, r: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """Codewords of least loss for given codes: a 2 x 2 system for each."""
        picked = np.stack([self.books[s][codes[:, s]] for s in range(len(self.books))], axis=1)
        along = ((r - picked) * u).sum(-1)
        total, more = along.sum(1), self.eta - 1
        for s in range(len(self.books)):
            rest = total - along[:, s]
            for k in range(CODES):
                here = codes[:, s] == k
                if not here.any():
                    continue
                us, rs = u[here, s], r[here, s]
                left = here.sum() * np.eye(DIMS) + more * us.T @ us
                right = rs.sum(0) + more * ((rest[here] + (rs * us).sum(1))[:, None] * us).sum(0)
                self.books[s, k] = np.linalg.solve(left, right)
            along[:, s] = ((r[:, s] - self.books[s][codes[:, s]]) * u[:, s]).sum(1)
            total = rest + along[:, s]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Cell and packed 4-bit codes of every vector."""
        x = self.unit(vectors)
        cell = self.assign(x)
        codes = self._codes(*self._split(x, cell), 2).astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        packed = codes[:, 0::2] | codes[:, 1::2] << 4
        return cell, [p.tobytes() for p in packed]

    def probes(self, vectors: np.ndarray, entries: np.ndarray) -> list[np.ndarray]:
        """Cells that each query visits, nearest first."""
        order = self.order(vectors)
        held = entries[order].cumsum(axis=1)
        need = (held < min(LEAST_ENTRIES, int(entries.sum()))).sum(axis=1) + 1
        return [o[: max(self.visits, n)][entries[o[: max(self.visits, n)]] > 0] for o, n in zip(order, need)]

    def scan(self, queries: np.ndarray, cell: int, packed: list[bytes]) -> np.ndarray:
        """Estimated cosines (queries, entries) of entries of one cell, from tables of 16 products for each code."""
        q = self.unit(queries)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        subs = self.books.shape[0]
        pad = np.pad(q, ((0, 0), (0, subs * DIMS - q.shape[1]))).reshape(len(q), subs, DIMS)
        tables = (np.einsum("qsd,skd->qsk", pad, self.books) * self.scales[cell]).astype(np.float32)
        out = np.repeat((q @ self.centres[cell])[:, None].astype(np.float32), len(raw), axis=1)
        for s in range(subs):
            out += tables[:, s][:, raw[:, s // 2] >> (4 * (s % 2)) & 15]
        return out


def levelled(x: np.ndarray) -> np.ndarray:
    """x in double precision, each vector by a power of two that brings its largest component between 1/2 and 1: exact, and squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0.0))[1])


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision along the last axis; each depends on its two vectors only."""
    q, x = levelled(query), levelled(vectors)
    return (x * q).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((q * q).sum(axis=-1)))


def reranked(query: np.ndarray, vectors: np.ndarray, guess: np.ndarray, few: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact cosines of all entries whose estimate, raised by the largest error seen, reaches the top-th cosine; at least the few best by estimate."""
    order = np.flatnonzero(np.isfinite(guess))
    order = order[np.argsort(-guess[order], kind="stable")]
    ahead, scores, n = -guess[order].astype(np.float64), np.zeros(0), min(few, len(order))
    while len(scores) < n:
        scores = np.append(scores, exact(query, vectors[order[len(scores) : n]]))
        if n >= top:
            least, error = np.partition(scores, n - top)[n - top], np.abs(scores + ahead[:n]).max()
            n = max(n, int(np.searchsorted(ahead, error - least, side="right")))
    return order[:n], scores


def shards_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every cell: small cells share a shard, large ones are cut."""
    first, cuts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shard, fill = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if fill and fill + n > SHARD_ENTRIES:
            shard, fill = shard + 1, 0
        first[c], cuts[c] = shard, max(1, -(-n // SHARD_ENTRIES))
        fill += n
        if cuts[c] > 1:
            shard, fill = shard + int(cuts[c]), 0
    return first, cuts


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding of the rows that take part, once each."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def _array(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def second_tier(entries: DataFrame, index: Index, cells: int, total: int) -> Index:
    """Cut the first cells on the executors: k-means over a sample of their entries, in pieces of about PIECE of them."""
    dims, kind = index.centres.shape[1], dict(entries.dtypes)["embedding"]
    share = min(1.0, CELL_SAMPLE * cells / total)
    part = entries.where(F.pmod(F.xxhash64("entry", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("entry", "embedding")
    shared = entries.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.assign(Index.unit(_array(batch.column(1), dims)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "entry", "embedding"])

    placed = written(part.mapInArrow(place, f"cell int, entry long, embedding {kind}"), "second-tier")
    pieces = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))  # one row for each first cell at most

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = Index.unit(np.stack(rows.sort_values("entry")["embedding"].to_numpy()))
        n = max(1, round(len(x) * cells / (share * total)))
        return pd.DataFrame({"cell": key[0], "centre": list(k_means(x, min(n, len(x)), ROUNDS, np.random.default_rng(7)))})

    dealt = placed.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("entry"), F.col("pieces")))
    got = dealt.select("cell", "piece", "entry", "embedding").groupBy("cell", "piece").applyInPandas(cut, "cell int, centre array<double>").toArrow()  # within CENTRE_BYTES, as cells is
    dropped(entries.sparkSession, placed)
    if not got.num_rows:
        return index
    centres, of = _array(got.column("centre").combine_chunks(), dims), got.column("cell").to_numpy()
    order = np.lexsort((*centres.T[::-1], of))
    return index.tiers(centres[order], of[order])


def measured_visits(coded: DataFrame, index: Index, pilots: np.ndarray, k: int) -> int:
    """How many cells hold COVERED of the true neighbours of the pilots among all rows."""
    spark, dims = coded.sparkSession, pilots.shape[1]
    shared = spark.sparkContext.broadcast(Index.unit(pilots))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            if batch.num_rows:
                scores = asked @ Index.unit(_array(batch.column(1), dims)).T
                few = min(k + 1, batch.num_rows)
                top = np.argpartition(-scores, few - 1, axis=1)[:, :few]
                cell = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), few), pa.int32()), pa.array(np.take_along_axis(scores, top, 1).ravel()), pa.array(cell[top].ravel(), pa.int32())], names=["pilot", "score", "cell"])

    found = coded.select("cell", "embedding").mapInArrow(nearest, "pilot int, score double, cell int")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("pilot").orderBy(F.desc("score"), "cell"))).where((F.col("r") <= k + 1))
    cells: list[list[int]] = [[] for _ in pilots]
    for row in sorted(best.select("pilot", "r", "score", "cell").collect()):  # at most k + 1 rows for each of PILOTS
        own = row["r"] == 1 and row["score"] > 1 - 1e-12  # the pilot itself
        if not own and len(cells[row["pilot"]]) < k:
            cells[row["pilot"]].append(row["cell"])
    return index.least_visits(pilots, [np.array(c, np.int64) for c in cells])


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """The k nearest of vectors for each row of queries(vec_id, embedding): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    v = usable(vectors, vec_id, embedding)
    some = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = v.withColumn("place", some).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.col("ids")[0]), "entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], out)
    dims = len(sample[0])
    sample = _array(sample, dims).astype(np.float64)
    total = entries.count()
    cells = max(1, min(int(np.sqrt(total) / 2), CENTRE_BYTES // (8 * dims)))
    index = Index.fit(sample, min(FIRST_CELLS, cells))
    if cells > FIRST_CELLS:
        index = second_tier(entries, index, cells, total)
    shared = spark.sparkContext.broadcast(index.learn(sample))  # at most CENTRE_BYTES of centres, and 16 codewords for every two dimensions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = shared.value.encode(_array(batch.column(1), dims))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(codes, pa.binary()), batch.column(1), batch.column(2)], names=["entry", "cell", "codes", "embedding", "ids"])

    kind = dict(entries.dtypes)["embedding"]
    coded = written(entries.select("entry", "embedding", "ids").mapInArrow(encode, f"entry long, cell int, codes binary, embedding {kind}, ids array<long>"), "coded")
    sizes = np.zeros(len(index.centres), np.int64)
    for row in coded.groupBy("cell").count().collect():  # at most one row for each cell
        sizes[row["cell"]] = row["count"]
    first, cuts = shards_of(sizes)
    asked = usable(queries, vec_id, embedding).where(F.size("embedding") == dims).select("vec_id", F.col("embedding").cast(kind).alias("embedding")).distinct()
    asked_once = written(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")), "asked")
    pilots = asked_once.orderBy(F.xxhash64("query"), "query").limit(PILOTS).select("embedding").toArrow().column("embedding").combine_chunks()
    if not len(pilots):
        return spark.createDataFrame([], out)
    index.visits = measured_visits(coded, index, _array(pilots, dims), k)
    plan = spark.sparkContext.broadcast((index, sizes, first, cuts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_index, counts, starts, parts = plan.value
        step = max(1, min(256, BLOCK // len(counts)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                at, shard, cells = [], [], []
                for i, near in enumerate(asked_index.probes(_array(some.column(1), dims), counts)):
                    by: dict[int, list[int]] = {}
                    for c in near.tolist():
                        for b in range(parts[c]):
                            by.setdefault(int(starts[c]) + b, []).append(c)
                    at += [i] * len(by)
                    shard += by
                    cells += by.values()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(cells, pa.list_(pa.int32())), some.column(0).take(take), some.column(1).take(take)], names=["shard", "cells", "query", "embedding"])

    visits = written(asked_once.select("query", "embedding").mapInArrow(probe, f"shard int, cells array<int>, query long, embedding {kind}"), "visits")
    batches = written(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BATCH).cast("int").alias("batches")), "batches")
    visits = visits.join(batches, "shard").withColumn("batch", F.pmod(F.xxhash64("query"), F.col("batches")).cast("int")).drop("batches")
    where = spark.createDataFrame([(c, int(a), int(b)) for c, (a, b) in enumerate(zip(first, cuts))], "cell int, start int, cuts int")  # one row for each cell
    held = coded.join(F.broadcast(where), "cell").withColumn("shard", F.col("start") + F.pmod(F.xxhash64("entry"), F.col("cuts")).cast("int")).drop("start", "cuts")
    held = held.join(batches, "shard").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def meet(key: tuple, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return pd.DataFrame({"query": [], "entry": [], "ids": [], "score": []}).astype({"query": "int64", "entry": "int64", "score": "float64"})
        e, q = e.sort_values(["cell", "entry"]), q.sort_values("query")
        x, asked_ = np.stack(e["embedding"].to_numpy()), np.stack(q["embedding"].to_numpy())
        entry, ids, codes, cell = e["entry"].to_numpy(), e["ids"].to_numpy(), e["codes"].tolist(), e["cell"].to_numpy()
        spans = [(int(c), *np.searchsorted(cell, [c, c + 1])) for c in np.unique(cell)]
        visited = [set(c.tolist()) for c in q["cells"]]
        few, top, parts = min(rerank, len(x)), min(k + 1, len(x)), []
        for at in range(0, len(q), 64):
            some = slice(at, at + 64)
            guess = np.full((len(asked_[some]), len(x)), -np.inf, np.float32)
            for c, i, j in spans:
                rows = [r for r, v in enumerate(visited[some]) if c in v]
                if rows:
                    guess[rows, i:j] = shared.value.scan(asked_[some][rows], c, codes[i:j])
            near = np.argpartition(-guess, few - 1, axis=1)[:, :few]
            scores = exact(asked_[some][:, None], x[near])
            near_guess = np.take_along_axis(guess, near, 1)
            scores[~np.isfinite(near_guess)] = -np.inf
            error = np.abs(np.where(np.isfinite(scores), scores, 0) - np.where(np.isfinite(near_guess), near_guess, 0)).max(axis=1)
            least = np.partition(scores, few - top, axis=1)[:, few - top]
            far = (np.isfinite(guess) & (guess >= (least - error)[:, None])).sum(axis=1) > few
            for i in np.flatnonzero(far).tolist():
                places, cosines = reranked(asked_[some][i], x, guess[i], few, top)
                best = np.lexsort((entry[places], -cosines))[:top]
                near[i, :top], scores[i, :top], scores[i, top:] = places[best], cosines[best], -np.inf
            best = np.lexsort((entry[near], -scores), axis=1)[:, :top]
            parts.append((np.repeat(q["query"].to_numpy()[some], top), np.take_along_axis(near, best, 1).ravel(), np.take_along_axis(scores, best, 1).ravel()))
        query, hit, score = (np.concatenate(p) for p in zip(*parts))
        seen = np.isfinite(score)
        return pd.DataFrame({"query": query[seen], "entry": entry[hit[seen]], "ids": ids[hit[seen]], "score": score[seen]})

    on = ["shard", "batch"]
    found = held.groupBy(*on).cogroup(visits.groupBy(*on)).applyInPandas(meet, "query long, entry long, ids array<long>, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "entry")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    named = asked.join(asked_once, "embedding").select(F.col("vec_id").alias("query_id"), "query").join(found, "query")
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("s"), i.alias("i")))))
    hits = F.slice(F.array_sort(F.filter(flat, lambda h: h["i"] != F.col("query_id"))), 1, k)
    return named.select("query_id", F.posexplode(hits).alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.i").alias("vec_id"), (-F.col("h.s")).alias("score"))


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op2_ann_search": op2_ann_search}
ORACLE: dict[str, str] = {}
