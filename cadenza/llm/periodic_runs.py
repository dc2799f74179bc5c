"""Runs of words that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same)
and at least max(SHORTEST, EXPONENT * q) words that no neighbouring word extends. Words are
maximal stretches of other bytes than blank, tab, line feed, vertical tab, form feed and return.

*Masking.* A run and its own shift by a period share at least k words (`shortest_overlap`), so
each of its words lies in a k-gram that stands twice in the document. Words outside such k-grams
cannot join a run and are masked; what is left falls into segments, a few words in most texts.

*Main-Lorentz.* Segments are halved down to the shortest run. A run that a cut goes through has
two periods on one side of it, so for each period p two windows of p words beside the cut must be
equal; where they are, the stretch is extended both ways inside the block, and one that could be
extended beyond it is left to a larger block. All blocks of one depth, of all documents of a
group, are worked on together in numpy: equality of windows is looked up in names of windows of
2^j words (two windows are equal if their names are), so nothing rests on hashes but the mask,
where equal hashes of different k-grams would only keep words.

Defined results: null texts count as empty, empty and blank texts have no runs and collapse to
""; a text is worked on whole, with some 70 bytes for each word of its surviving segments; of
stretches with several periods the smallest counts; runs are listed by start, then period;
rows that repeat are rows of their own; an empty table gives no rows. Further columns are
carried along, but for those with the names of results.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import carried, table

SHORTEST, EXPONENT = 6, 4
#: Words of the documents that a task works on together; a longer document is a group of its own.
WORDS = 400_000
#: Names are kept for windows of up to 2^NAMED words; longer ones are compared piece by piece.
NAMED = 16
RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def shortest_overlap(shortest: int = SHORTEST, exponent: int = EXPONENT) -> int:
    """Words that the shortest run of any period shares with its shift by that period."""
    return min(max(shortest, exponent * q) - q for q in range(1, -(-shortest // exponent) + 1))


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of groups of these sizes, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def surviving(words: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that stands at two places of its document; of: the document of each word, ascending."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(len(words), bool)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    gram = of[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(k):
        gram = gram * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + n]
    gram ^= gram >> np.uint64(32)
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    order = at[np.argsort(gram[at])]
    same = gram[order[1:]] == gram[order[:-1]]
    edge = np.zeros(len(words) + 1, np.int32)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + k, -1)
    return np.cumsum(edge[:-1]) > 0


class Windows:
    """Names of the windows of 2^j words; equal names, equal words."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.top = min(NAMED, max(0, longest.bit_length() - 1))
        self.names = np.zeros((self.top + 1, len(words)), np.int32)
        self.names[0] = np.unique(words, return_inverse=True)[1]
        for j in range(1, self.top + 1):
            low, half = self.names[j - 1].astype(np.int64), 1 << (j - 1)
            pair = (low + 1) * (len(words) + 1)
            pair[:-half] += low[half:] + 1
            self.names[j] = np.unique(pair, return_inverse=True)[1]

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the windows of these sizes (1 or more) at a and b have the same words."""
        j = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, self.top)
        step = np.left_shift(1, j)
        same = self.names[j, a] == self.names[j, b]
        done = step.copy()
        live = np.flatnonzero(same & (done < size))
        while live.size:
            at = np.minimum(done[live], size[live] - step[live])
            same[live] = self.names[j[live], a[live] + at] == self.names[j[live], b[live] + at]
            done[live] += step[live]
            live = live[same[live] & (done[live] < size[live])]
        return same

    def extent(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from a and b on (back: before a and b), at most limit."""
        done = np.zeros(len(a), np.int64)
        for j in range(self.top, -1, -1):
            step = 1 << j
            live = np.flatnonzero(done + step <= limit)
            while live.size:
                shift = -done[live] - step if back else done[live]
                live = live[self.names[j, a[live] + shift] == self.names[j, b[live] + shift]]
                done[live] += step
                if j < self.top:
                    break
                live = live[done[live] + step <= limit[live]]
        return done


def repetitions(words: np.ndarray, first: np.ndarray, stop: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, stop, period) of the runs inside the segments [first, stop), by start and period.

    Every segment has a word before it and one after it that stands nowhere else.
    """
    least = max(shortest, exponent)
    found = [np.zeros((0, 3), np.int64)]
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    windows = Windows(words, int((stop - first).max(initial=0)) // exponent)
    low, high = first, stop
    while (wide := high - low >= least).any():
        low, high = low[wide], high[wide]
        cut, periods = (low + high) // 2, (high - low) // exponent
        p, block = _places(periods) + 1, np.repeat(np.arange(len(low)), periods)
        m = cut[block]
        for base in (m, m - p):  # a run of four periods has two behind the cut, or two before it
            other = base + p
            beside = (base, other) if base is m else (base - p, base)
            hit = np.flatnonzero(windows.equal(*beside, p)) if exponent >= 4 else np.arange(len(p))  # of fewer periods one side may hold one only
            a, b, q, l, h = base[hit], other[hit], p[hit], low[block[hit]], high[block[hit]]
            start = a - windows.extent(a, b, a - l, back=True)
            end = b + windows.extent(a, b, h - b)
            good = (end - start >= np.maximum(shortest, exponent * q)) & (words[start - 1] != words[start - 1 + q]) & (words[end] != words[end - q])
            found.append(np.stack([start[good], end[good], q[good]], axis=1))
        low, high = np.concatenate([low, cut]), np.concatenate([cut, high])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # multiples of a period give the same stretch again
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(words: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs; words: numbers from 0, of documents of these sizes end to end."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    left = surviving(words, of, shortest_overlap(shortest, exponent))
    turn = np.ones(len(words) + 1, bool)
    turn[1:-1] = (left[1:] != left[:-1]) | (of[1:] != of[:-1])
    edges = np.flatnonzero(turn)
    at, end = edges[:-1], edges[1:]
    kept = left[at] & (end - at >= max(shortest, exponent)) if len(at) else np.zeros(0, bool)
    at, end = at[kept], end[kept]
    if not len(at):
        return np.zeros((0, 4), np.int64)
    size = end - at
    first = np.cumsum(size + 1) - size
    apart = np.full(int(size.sum()) + len(size) + 1, -1, np.int64)
    apart[np.repeat(first, size) + _places(size)] = words[np.repeat(at, size) + _places(size)]
    gaps = np.flatnonzero(apart < 0)
    apart[gaps] = words.max() + 1 + np.arange(len(gaps))
    rows = repetitions(apart, first, first + size, shortest, exponent)
    segment = np.searchsorted(first, rows[:, 0], "right") - 1
    doc = of[at[segment]]
    begin = np.cumsum(sizes) - sizes
    return np.stack([doc, rows[:, 0] - first[segment] + at[segment] - begin[doc], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)


def collapse(texts: list[list[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> tuple[np.ndarray, list[bytes]]:
    """Runs of texts that are lists of words, and what is left of each without the words that a run contains after its first period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    runs = runs_of(words, sizes, shortest, exponent)
    out = [b" ".join(t) if not k else b"" for t, k in zip(texts, np.bincount(runs[:, 0], minlength=len(texts)))]
    for doc, some in itertools.groupby(runs.tolist(), key=lambda r: r[0]):
        edge = np.zeros(len(texts[doc]) + 1, np.int32)
        for _, start, length, period in some:
            edge[start + period] += 1
            edge[start + length] -= 1
        out[doc] = b" ".join(itertools.compress(texts[doc], (np.cumsum(edge[:-1]) == 0).tolist()))
    return runs, out


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, order: Callable[[object, int], np.ndarray | None] | None = None, key: str = "doc_id", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """docs[keep] plus n_words, runs (array of start, length and period, in words) and collapsed (the words left, one blank apart).

    order(value of key, number of words), if given, says which of its words a text consists of (None: as they stand).
    """
    keep = carried(docs, ("n_words", "runs", "collapsed"), text) if keep is None else keep
    source = docs.select(*keep, docs[key].alias("__key"), docs[text].cast("binary").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def split(value: object, raw: bytes | None) -> list[bytes]:
        words = (raw or b"").split()  # bytes.split() takes the six ASCII blanks
        picked = order(value, len(words)) if order is not None else None
        return words if picked is None else [words[i] for i in picked.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keep)).to_pylist()
            at, some, n = 0, [], 0
            for i, value in enumerate(values):
                some.append(split(value, batch.column(len(keep) + 1)[i].as_py()))
                n += len(some[-1])
                if n >= WORDS or i + 1 == len(values):
                    runs, left = collapse(some, shortest, exponent)
                    ends = np.searchsorted(runs[:, 0], np.arange(len(some) + 1)).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_ARROW_RUN)))
                    carry = [c.slice(at, len(some)) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*carry, pa.array([len(t) for t in some], pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())], names=schema.names)
                    at, some, n = i + 1, [], 0

    return source.mapInArrow(run, schema)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule for every tenth document or so: from word a on, the next p words again and again. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, and digests of them and of what is left without repeats."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), order=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period")
    return out.select("doc_id", "n_runs", start, length, period, F.floor(1000 * F.col("b.l") / -F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE: dict[str, str] = {}
