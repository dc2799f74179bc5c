"""Rank statistics: average-tie ranks, Pearson, Spearman, cluster bootstrap.

Ranks of a large group are not left to one task: values are counted first, quantiles cut
each group's values into slices, and a running sum inside a slice continues from the
slices before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import digests
from cadenza.operators import resampling, slices
from cadenza.operators.common import join_on, settled

SLICES = 64


def average_ranks(df: DataFrame, group: list[str], value: str, out: str = "rank", times: str | None = None) -> DataFrame:
    """(group, value, out): rank from 1 of every distinct value, ties sharing the mean of their places.

    Null and NaN values are left out; -0.0 ties with 0.0. times: a column that says how many rows a row stands for.
    """
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, value).agg(n.alias("__n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)]).alias("__cuts"))
    sliced = join_on(counts, cuts, group).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    sizes = sliced.groupBy(*group, "__slice").agg(F.sum("__n").alias("__s"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__s").over(W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.select(*group, "__slice", "__before")
    inside = W.partitionBy(*group, "__slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__n").over(inside), F.lit(0)) + F.col("__before")
    return join_on(sliced, sizes, [*group, "__slice"]).select(*group, value, (ahead + (F.col("__n") + 1) / F.lit(2.0)).alias(out))


def with_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of each row's value in its group."""
    return join_on(df, average_ranks(df, group, value, out), [*group, value])


def pearson(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """Aggregate over rows with their group's means at hand: 0 for under two rows or without spread."""
    dx, dy = x - mx, y - my
    spread = F.sqrt(F.sum(dx * dx) * F.sum(dy * dy))
    return F.when((F.count(F.lit(1)) < 2) | (spread < 1e-15), F.lit(0.0)).otherwise(F.sum(dx * dy) / F.when(spread < 1e-15, F.lit(1.0)).otherwise(spread))


def correlate(df: DataFrame, group: list[str], x: str, y: str, out: str = "r") -> DataFrame:
    """Pearson correlation by group, means first (two passes, for numerical safety)."""
    joined = join_on(df, df.groupBy(*group).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my")), group)
    return joined.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y), F.col("__mx"), F.col("__my")).alias(out))


def spearman(df: DataFrame, group: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """n and Spearman correlation by group: Pearson of average-tie ranks, whose mean is (n + 1) / 2. 0 for under two rows or without spread.

    Equal pairs are counted once, before they are ranked; the counts are kept, as they are read several times.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    clean = df.where(xs.isNotNull() & ys.isNotNull() & ~F.isnan(xs) & ~F.isnan(ys)).select(*group, xs.alias("__x"), ys.alias("__y"))
    pairs = settled(clean.groupBy(*group, "__x", "__y").agg(F.count(F.lit(1)).alias("__t")))
    total = pairs.groupBy(*group).agg(F.sum("__t").alias("n"))
    ranked = join_on(pairs, average_ranks(pairs, group, "__x", "__rx", "__t"), [*group, "__x"])
    ranked = join_on(join_on(ranked, average_ranks(pairs, group, "__y", "__ry", "__t"), [*group, "__y"]), total, group)
    dx, dy, t = F.col("__rx") - (F.col("n") + 1) / 2, F.col("__ry") - (F.col("n") + 1) / 2, F.col("__t")
    sums = ranked.groupBy(*group).agg(F.max("n").alias("n"), F.sum(t * dx * dy).alias("__xy"), F.sqrt(F.sum(t * dx * dx) * F.sum(t * dy * dy)).alias("__s"))
    flat = (F.col("n") < 2) | (F.col("__s") < 1e-15)
    rho = F.when(flat, F.lit(0.0)).otherwise(F.col("__xy") / F.when(flat, F.lit(1.0)).otherwise(F.col("__s")))
    return sums.select(*group, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(rho, F.lit(0.0)).alias(out))


def _numbered(rows: DataFrame, cluster: str, group: list[str]) -> DataFrame:
    """(group, cluster, g, total): different clusters, numbered from 0 in their order."""
    different = rows.select(*group, cluster).distinct().withColumn("__one", F.lit(1))
    return slices.placed(different, [*group, "__one"], [cluster]).select(*group, cluster, F.col("__t").alias("g"), F.col("__n").alias("total"))


def _times(numbers: DataFrame, first: int, replicates: int, seed: int, group: list[str]) -> DataFrame:
    """(group, b, g, times): how often replicates first, first + 1, ... draw each cluster, by md5(seed:b:j) modulo the number of clusters."""
    draws = numbers.select(*group, "g", "total").withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "b", "g")), 1, 8), 16, 10).cast("long") % F.col("total")
    return draws.select(*group, "b", pick.alias("g")).groupBy(*group, "b", "g").agg(F.count(F.lit(1)).alias("times"))


def _clean(df: DataFrame, x: str, y: str, cluster: str, group: list[str]) -> DataFrame:
    d = df.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).alias("__c"))
    return d.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


class WeightedRanks:
    """Spearman's rho of many resamples at once: the rows stay, each replicate weighs them by how often it draws their cluster.

    Equal rows of a cluster are counted first. Of x and y the one with more different values is cut into parts by
    quantiles, once. A part is pieces of sorted rows as numpy arrays; a pass of replicates reads them where they lie,
    so passes move no rows. Ranks inside a part start from 0: what stands before a part only adds multiples of the
    part's sums, so a part returns its sums (`pieces_sums`) and the driver puts parts together. The side with few values
    is ranked there too, from weights by value; with so many values that parts could not return them, it is ranked first, in a
    table of bounded size that is broadcast.
    """

    #: Numbers in a broadcast table of values by replicates, and in one of clusters by replicates (mostly of one byte); numbers that parts return at most;
    #: replicates at least in a pass, groups and parts at most; rows of a part and of a piece; columns worked on together.
    CELLS, DRAWN, RETURNED, LEAST, GROUPS, SLICES, ROWS, PIECE, COLUMNS = 4_000_000, 40_000_000, 4_000_000, 20, 1000, 1024, 500_000, 65_536, 64
    #: Digests of a task that draws.
    DIGESTS = 4_000_000

    def __init__(self, clean: DataFrame, group: list[str]) -> None:
        key = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(group)]), {"ignoreNullFields": "false"}) if group else F.lit("")
        named = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
        self.numbers = settled(_numbered(clean, "__c", group).select(key.alias("key"), F.col("__c").alias("__n"), "g", "total", *named))
        self.totals = settled(self.numbers.groupBy("key").agg(F.max("total").alias("t")))  # every pass reads it
        self.clusters = self.totals.agg(F.sum("t")).first()[0] or 1
        numbers = self.numbers.select("key", "__n", "g")
        if self.clusters * self.LEAST <= self.DRAWN:  # rows need not be sorted to find a number
            numbers = numbers.hint("shuffle_hash")
        keyed = clean.select(key.alias("__k"), "x", "y", "__c")
        joined = keyed.join(numbers, (F.col("__k") == F.col("key")) & F.col("__c").eqNullSafe(F.col("__n")))
        zero = lambda c: (F.col(c) + 0.0).alias(c)  # noqa: E731  # -0.0 ties with 0.0
        self.counts = joined.groupBy("key", "g", zero("x"), zero("y")).agg(F.count(F.lit(1)).alias("n"))
        self.counts = settled(self.counts)
        size = self.counts.groupBy("key").agg(F.approx_count_distinct("x").alias("dx"), F.approx_count_distinct("y").alias("dy"), F.count(F.lit(1)).alias("rows")).limit(self.GROUPS + 1).toArrow().to_pydict()
        self.groups = len(size["key"])
        self.parts = {k: int(min(self.SLICES, max(1, -(-n // self.ROWS)))) for k, n in zip(size["key"], size["rows"])}
        dx, dy = 2 * sum(size["dx"]), 2 * sum(size["dy"])  # the estimate may be too small
        self.few, self.many = ("y", "x") if dy <= dx else ("x", "y")
        self.values = dict(zip(size["key"], size[f"d{self.few}"]))
        self.block = min(self.DRAWN // max(1, self.clusters), self.CELLS // max(1, min(dx, dy)))

    def sizes(self, group: list[str]) -> DataFrame:
        """(group, __key, n, g): rows and clusters, null and empty names being one. One row without group."""
        rows = self.counts.groupBy(F.col("key").alias("__key")).agg(F.sum("n").alias("n"))
        clusters = F.count_distinct(F.coalesce(F.col("__n").cast("string"), F.lit(""))).alias("g")
        if not group:
            return self.numbers.agg(clusters).withColumn("__key", F.lit("")).join(F.broadcast(rows.withColumnRenamed("__key", "__k")), F.col("__key") == F.col("__k"), "left").select("__key", F.coalesce("n", F.lit(0)).alias("n"), "g")
        named = [f"__g{i}" for i in range(len(group))]
        found = self.numbers.groupBy(*named, "key").agg(clusters).join(rows, F.col("key") == F.col("__key"))
        return found.select(*[F.col(c).alias(name) for c, name in zip(named, group)], "__key", "n", "g")

    def fits(self) -> bool:
        return self.groups <= self.GROUPS and self.block >= self.LEAST

    def rhos(self, replicates: int, seed: int) -> dict[str, np.ndarray]:
        """Rho of every replicate by key of the group."""
        passes = max(1, -(-replicates // self.block))
        b = max(1, -(-replicates // passes))  # equally wide
        self.ranked_first = 2 * b * sum(2 * n * self.parts[k] for k, n in self.values.items()) > self.RETURNED
        self._deal()
        parts = [self._pass(first, min(b, replicates - first), seed) for first in range(0, replicates, b)]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}

    def _deal(self) -> None:
        """What all passes share: rows in parts of the side with many values; where the other side is ranked first, its rows by value."""
        many = self.counts.select("key", F.col(self.many).alias("u"), F.col(self.few).alias("v"), "g", "n")
        cut = {k: n for k, n in self.parts.items() if n > 1}
        if cut:
            table = self.counts.sparkSession.createDataFrame(list(cut.items()), "__k string, __parts int")  # a row a group
            cuts = many.groupBy("key").agg(F.percentile_approx("u", [i / self.SLICES for i in range(1, self.SLICES)]).alias("all"))
            cuts = cuts.join(F.broadcast(table), F.col("key") == F.col("__k"), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
            chosen = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("__parts") - 1)), lambda i: F.get("all", F.floor(i * self.SLICES / F.col("__parts")).cast("int") - 1))
            cuts = cuts.select(F.col("key").alias("__k"), F.when(F.col("__parts") > 1, F.array_distinct(chosen)).otherwise(F.array().cast("array<double>")).alias("cuts"))
            many = many.join(F.broadcast(settled(cuts)), F.col("key") == F.col("__k")).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("u")))).drop("__k", "cuts")
        else:
            many = many.withColumn("slice", F.lit(0))
        piece = self.PIECE
        self.packed = settled(many.groupBy("key", "slice").applyInArrow(lambda part: _pieces(part, piece), PIECES))
        if self.ranked_first:
            each = self.counts.groupBy("key", F.col(self.few).alias("v"), "g").agg(F.sum("n").alias("n"))
            self.by_value = settled(each.select("key", "v", "g", "n").repartition("key", "v").sortWithinPartitions("key", "v"))

    def _draws(self, first: int, b: int, seed: int) -> dict[str, np.ndarray]:
        """By key, clusters by replicates: how often replicates first, first + 1, ... draw each cluster, as _times."""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (t, rep) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    n = np.bincount(digests.leading(f"{seed}:{rep}:".encode(), t) % np.uint32(t), minlength=t)
                    n = n.astype(np.uint8 if n.max() < 256 else np.uint32)
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([n.tobytes()], pa.binary())], names=["key", "t", "b", "n"])

        tasks = max(1, min(b * max(1, self.groups), -(-self.clusters * b // self.DIGESTS)))
        asked = self.totals.withColumn("b", F.explode(F.sequence(F.lit(first), F.lit(first + b - 1)))).repartition(int(tasks))
        rows: dict[str, list] = {}
        for part in asked.select("key", F.col("t").cast("long"), F.col("b").cast("long")).mapInArrow(draw, "key string, t long, b long, n binary").toArrow().to_batches():  # within DRAWN
            for k, t, rep, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                n = np.frombuffer(n.as_buffer(), np.uint8 if len(n.as_buffer()) == t else np.uint32)
                rows.setdefault(k, [None] * b)[rep - first] = n
        return {k: np.stack(n, axis=1) for k, n in rows.items()}

    def _pass(self, first: int, b: int, seed: int) -> dict[str, np.ndarray]:
        sc, width = self.counts.sparkSession.sparkContext, self.COLUMNS
        drawn_by = sc.broadcast({k: [np.ascontiguousarray(d[:, c : c + width]) for c in range(0, b, width)] for k, d in self._draws(first, b, seed).items()})
        table = self._few_ranks(drawn_by) if self.ranked_first else None
        ranks = sc.broadcast({k: (t["v"], [np.ascontiguousarray(t["off"][:, c : c + width]) for c in range(0, b, width)]) for k, t in (table or {}).items()})  # within CELLS

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each part: pieces of a part stand together, in their order."""
            at, open_ = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    found = pieces_sums(row, drawn_by.value[row["key"]], ranks.value.get(row["key"]))
                    if at == (row["key"], row["slice"]):
                        open_ = together(open_, found)
                        continue
                    if at is not None:
                        yield _sums_row(at, open_)
                    at, open_ = (row["key"], row["slice"]), found
            if at is not None:
                yield _sums_row(at, open_)

        parts: dict[str, list] = {}
        for row in self.packed.mapInArrow(sums, "key string, slice int, v binary, sums binary").toArrow().to_pylist():  # a row a part, within RETURNED
            parts.setdefault(row["key"], []).append((row["slice"], np.frombuffer(row["v"]), np.frombuffer(row["sums"]).reshape(-1, b)))
        drawn_by.destroy()
        ranks.destroy()
        return {k: _rho(sorted(p, key=lambda x: x[0]), table and table[k]) for k, p in parts.items()}

    def _few_ranks(self, drawn_by) -> dict[str, dict[str, np.ndarray]]:  # noqa: ANN001
        """Of the side with fewer values: values, their ranks less the mean for every replicate, the mean, the sum of squares."""

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, v, g, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for k in np.unique(keys.astype(str)).tolist():
                    here = keys == k
                    order = np.argsort(v[here], kind="stable")
                    own, values = v[here][order], np.unique(v[here])
                    starts, at, times = np.searchsorted(own, values), g[here][order], n[here][order].astype(np.float64)[:, None]
                    w = np.concatenate([np.add.reduceat(times * drawn[at], starts, axis=0) for drawn in drawn_by.value[k]], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(values)), pa.array(values), pa.array([x.tobytes() for x in w], pa.binary())], names=["key", "v", "w"])

        got = self.by_value.mapInArrow(weigh, "key string, v double, w binary").toArrow()  # a row for each value, within CELLS, and a few more
        keys, v = got.column("key").to_numpy().astype(str), got.column("v").to_numpy()
        w = np.frombuffer(b"".join(got.column("w").to_pylist())).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        out = {}
        for k in np.unique(keys).tolist():
            here = np.flatnonzero(keys == k)
            values, at = np.unique(v[here], return_inverse=True)
            own = np.zeros((len(values), w.shape[1]))
            np.add.at(own, at, w[here])
            out[k] = {"v": values} | _ranked(own)
        return out


#: A piece: rows of a part by u and v as arrays. Rows of a pair (u, v) are cut into runs. g and n (null: all 1): first rows of all runs, longest run first, then
#: second rows and so on; steps: how many runs have such a row; order: place of each run among them; runs: first run of each pair; pairs: first pair of each u;
#: place: each pair's v among the values v.
PIECES = "key string, slice int, g binary, n binary, steps binary, order binary, runs binary, pairs binary, place binary, v binary"
#: Rows of a run: so many counts of up to 15 draws fit a byte.
RUN = 16


def _pieces(part: pa.Table, most: int) -> pa.Table:
    """Rows (key, slice, u, v, g, n) of a part as pieces of about `most` rows; equal u stay together."""
    key, piece = part.column("key")[0].as_py(), part.column("slice")[0].as_py()
    u, v, g, n = (part.column(c).to_numpy() for c in ("u", "v", "g", "n"))
    order = np.lexsort((v, u))
    u, v, g, n = u[order], v[order], g[order], n[order]
    new_u = np.append(True, u[1:] != u[:-1])
    starts = np.flatnonzero(new_u)
    cuts = [0]
    while (stop := cuts[-1] + most) < len(u) and (after := int(np.searchsorted(starts, stop))) < len(starts):
        cuts.append(int(starts[after]))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(u)]):
        rows = np.arange(b - a)
        is_u = new_u[a:b]
        is_pair = is_u | np.append(True, v[a + 1 : b] != v[a : b - 1])
        since = rows - np.maximum.accumulate(np.where(is_pair, rows, 0))
        is_run = since % RUN == 0
        run_of = np.cumsum(is_run) - 1
        first = np.flatnonzero(is_run)
        size = np.diff(np.append(first, b - a))
        long = np.argsort(-size, kind="stable")  # runs, longest first
        steps = np.array([(size > k).sum() for k in range(int(size.max()))])
        place_of = np.concatenate([first[long[:m]] + k for k, m in enumerate(steps.tolist())])
        back = np.empty(len(long), np.int64)
        back[long] = np.arange(len(long))
        pair_at = np.flatnonzero(is_pair)
        values, place = np.unique(v[a:b][pair_at], return_inverse=True)
        times = n[a:b][place_of]
        plain = bool((times == 1).all())
        arrays = [g[a:b][place_of].astype(np.int32), None if plain else times.astype(np.int64), steps.astype(np.int32), back.astype(np.int32), run_of[pair_at].astype(np.int32)]
        arrays += [np.flatnonzero(is_u[pair_at]).astype(np.int32), place.astype(np.int32), values.astype(np.float64)]
        out.append((key, piece, *[None if x is None else x.tobytes() for x in arrays]))
    names = ["key", "slice", "g", "n", "steps", "order", "runs", "pairs", "place", "v"]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 8]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(names, zip(*out), kinds)})


def _run_sums(drawn: np.ndarray, g: np.ndarray, n: np.ndarray | None, steps: list[int], small: bool) -> np.ndarray:
    """Weights of every run, longest first: step k adds the k-th row of the runs that have one."""
    if n is not None:
        kind = np.float64
    else:
        kind = np.uint8 if small else np.int64
    out, at = np.zeros((steps[0], drawn.shape[1]), kind), 0
    for m in steps:
        w = drawn.take(g[at : at + m], axis=0)
        out[:m] += w if n is None else w * n[at : at + m, None].astype(np.float64)
        at += m
    return out


def pieces_sums(row: dict, drawn_by: list[np.ndarray], ranks: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(values, sums) of a piece for every replicate, ranks inside the piece from 0.

    Rows of sums: the weight; sums of weight times rank and rank squared over values of u; then, for each value of v, its weight and the sum of
    weight times rank of u. With `ranks` of v known: instead of the latter two of all values, both times the rank of v, summed; values are empty then.
    """
    read = lambda c, kind: np.frombuffer(row[c], kind).astype(np.int64)
    g, n, steps, order, runs, pairs, place = (None if row[c] is None else read(c, kind) for c, kind in zip(("g", "n", "steps", "order", "runs", "pairs", "place"), (np.int32, np.int64, *[np.int32] * 5)))
    v = np.frombuffer(row["v"])
    size = np.diff(np.append(pairs, len(place)))
    by_v = np.argsort(place, kind="stable")
    v_at = np.searchsorted(place[by_v], np.arange(len(v)))
    out = []
    for i, drawn in enumerate(drawn_by):
        small = drawn.dtype == np.uint8 and int(drawn.max(initial=0)) * RUN < 256
        w = np.add.reduceat(_run_sums(drawn, g, n, steps.tolist(), small)[order], runs, axis=0, dtype=np.float64)
        own = np.add.reduceat(w, pairs, axis=0)
        rank = np.cumsum(own, axis=0) - own + (own + 1) / 2
        lead = np.stack([own.sum(axis=0), (own * rank).sum(axis=0), (own * rank * rank).sum(axis=0)])
        wr = w * np.repeat(rank, size, axis=0)
        if ranks is None:
            body = np.concatenate([np.add.reduceat(x[by_v], v_at, axis=0) for x in (w, wr)])
        else:
            off = ranks[1][i][np.searchsorted(ranks[0], v)[place]]
            body = np.stack([(w * off).sum(axis=0), (wr * off).sum(axis=0)])
        out.append(np.concatenate([lead, body]))
    return (v if ranks is None else v[:0]), np.concatenate(out, axis=1)


def _moved(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """sums of rows that stand `by` later."""
    w, wr, wrr, half = sums[0], sums[1], sums[2], (len(sums) - 3) // 2
    weights, ranked = sums[3 : 3 + half], sums[3 + half :]
    return np.concatenate([[w, wr + by * w, wrr + 2 * by * wr + by * by * w], weights, ranked + by * weights])


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(one[0]) and not len(other[0]):
        return one[0], one[1] + other[1]
    v = np.union1d(one[0], other[0])
    out = np.zeros((3 + 2 * len(v), one[1].shape[1]))
    for values, sums in (one, other):
        at = np.searchsorted(v, values)
        out[:3] += sums[:3]
        out[3 + at] += sums[3 : 3 + len(at)]
        out[3 + len(v) + at] += sums[3 + len(at) :]
    return v, out


def together(one: tuple[np.ndarray, np.ndarray], next_: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two neighbours, ranks inside both from 0."""
    return _added(one, (next_[0], _moved(next_[1], one[1][0])))


def _sums_row(at: tuple[str, int], found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), *[pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for x in found]]
    return pa.RecordBatch.from_arrays(columns, names=["key", "slice", "v", "sums"])


def _ranked(own: np.ndarray) -> dict[str, np.ndarray]:
    """Of values by replicates: ranks less their mean, the mean, the sum of squares."""
    mean = (own.sum(axis=0) + 1) / 2
    off = np.cumsum(own, axis=0) - own + (own + 1) / 2 - mean
    return {"off": off, "mean": mean, "yy": (own * off * off).sum(axis=0)}


def _rho(parts: list[tuple[int, np.ndarray, np.ndarray]], few: dict[str, np.ndarray] | None) -> np.ndarray:
    """Rho of every replicate from the sums of all parts; few: the ranks of v, where sums were taken with them."""
    mean = (sum(s[0] for _, _, s in parts) + 1) / 2
    before, whole = np.zeros_like(mean), None
    for _, v, sums in parts:
        found = v, _moved(sums, before - mean)  # ranks less their mean
        whole = _added(whole, found) if whole else found
        before = before + sums[0]
    half = (len(whole[1]) - 3) // 2
    if few is None:
        few = _ranked(whole[1][3 : 3 + half])
        xy = (few["off"] * whole[1][3 + half :]).sum(axis=0)
    else:
        xy = whole[1][4]
    spread = np.sqrt(whole[1][2] * few["yy"])
    flat = (spread < 1e-15) | (few["mean"] < 1.5)
    return np.where(flat, 0.0, xy / np.where(flat, 1.0, spread))


def cluster_bootstrap(df: DataFrame, x: str, y: str, cluster: str, replicates: int, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """(group, lo, hi): 2.5 and 97.5 percent points of Spearman's rho over resampled clusters. One row without group.

    Zeros for under ten rows, two clusters or one replicate. A point is the element at round(q (n - 1)).
    Tables too large for WeightedRanks (very many different values on both sides, clusters or groups) have both sides sliced (operators/resampling.py).
    """
    group = group or []
    clean = _clean(df, x, y, cluster, group)
    ranks = WeightedRanks(clean, group)
    sizes = ranks.sizes(group)
    if ranks.fits():
        found = ranks.rhos(replicates, seed)
        rows = [(k, sorted(r.tolist())) for k, r in found.items()]  # as many numbers as replicates for each of GROUPS groups at most
        ends = df.sparkSession.createDataFrame(rows, "__k string, rhos array<double>").withColumn("last", F.size("rhos") - 1)
        ends = sizes.join(F.broadcast(ends), F.col("__key") == F.col("__k"), "left")
    else:
        last = F.count(F.lit(1)) - 1
        found = resampling.rhos(ranks.counts, ranks.numbers, lambda first, many: _times(ranks.numbers, first, many, seed, ["key"]), replicates)
        ends = found.groupBy(F.col("key").alias("__k")).agg(F.array_sort(F.collect_list("rho")).alias("rhos"), last.alias("last"))  # as many values as replicates
        ends = sizes.join(ends, F.col("__key") == F.col("__k"), "left")
    at = lambda q: F.element_at("rhos", F.round(q * F.col("last")).cast("int") + 1)
    enough = (F.col("n") >= 10) & (F.col("g") >= 2) & (F.size("rhos") > 0)
    return ends.select(*group, F.when(enough, at(0.025)).otherwise(0.0).alias("lo"), F.when(enough, at(0.975)).otherwise(0.0).alias("hi"))
