"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score (ties: the
leftmost pair) and joins the best one until no pair spells a piece; the agendas of many
short chunks are worked off in step, as rows of numpy arrays. Symbols outside
the vocabulary become byte pieces. No piece of such a vocabulary holds the word mark
after another character, so a text falls apart into chunks (marks and the characters
after them, or the start of a line) whose agendas cannot touch. Chunks are encoded
once and kept in a bounded table of the Python worker. In every part of a batch the chunks
encoded for the first time are checked against the sentencepiece library.

Defined results: null texts count as empty; an empty text has no ids; texts of any
length are encoded whole (long chunks use a heap). Rows that repeat are rows of their own;
an empty table gives no rows. Other columns are carried along, but for those with the names
of results. A model that is not of merge type, or that normalises text, is refused.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cadenza.llm.common import carried, table, tidy

MARK = "▁"
#: Chunks of at most SHORT symbols keep their agenda in a list; longer ones use a heap. KEPT: chunks that a worker
#: remembers. BATCH, BATCH_BYTES: documents, and bytes of their texts, that are cut and looked up together (one at least).
SHORT, CHUNK_CHARS, KEPT, BATCH, BATCH_BYTES = 40, 40, 120_000, 2500, 1_500_000
#: Symbols that are no pieces: none, and (from STRANGE down) characters outside the vocabulary. The pair table has 2^TABLE_BITS places.
EMPTY, STRANGE, TABLE_BITS = -1, -2, 19
#: Chunks that are encoded in one go.
FRESH = 20_000


class MergeCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.digits = [str(i) for i in ids]
        if len(self.bytes) < 256 or any(sp.is_unused(i) for i in ids):
            raise ValueError(f"{model_file}: a model with byte fallback and no unused pieces is needed")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError(f"{model_file}: pieces that run over word marks or line ends are not supported")
        self._index_pairs()
        self.check(["a", " a  b ", "x\ny", "q" * 90, "ä中\U0001f600"])

    # -- encoding ---------------------------------------------------------------
    def _spell(self, symbols: list[str]) -> array:
        out = array("i")
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(i)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as 32-bit numbers. The agendas of short chunks of one length are rows of an array, all worked off in step."""
        out = [b""] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, begin = self.symbol[codes], np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > SHORT:
                for r in rows.tolist():
                    out[r] = self._spell(self._long(chunks[r])).tobytes()
                continue
            done = self._in_step(symbols[begin[rows][:, None] + np.arange(n)])
            count = (done != EMPTY).sum(axis=1).tolist()
            strange = (done <= STRANGE).any(axis=1).tolist()
            for r, ids, k, odd in zip(rows.tolist(), done, count, strange):
                out[r] = ids[:k].tobytes() if not odd else b"".join(i.tobytes() if i >= 0 else self._spell([chr(STRANGE - int(i))]).tobytes() for i in ids[:k])
        return out

    def _in_step(self, rows: np.ndarray) -> np.ndarray:
        """Work off the agendas of chunks of equal length (rows of symbols); joined rows end in EMPTY."""
        rows = np.pad(rows, ((0, 0), (0, 1)), constant_values=EMPTY)
        cost, into = self._pairs(rows[:, :-1], rows[:, 1:])
        live = np.arange(len(rows))
        while len(live):
            c = cost[live]
            best = c.argmin(axis=1)  # of equal scores the leftmost
            alive = np.isfinite(c[np.arange(len(live)), best])
            live, best = live[alive], best[alive]
            if not len(live):
                break
            s, c, m = rows[live], cost[live], into[live]
            at = np.arange(len(live))
            s[at, best] = m[at, best]
            keep = np.arange(s.shape[1] - 1)[None, :]
            keep = keep + (keep > best[:, None])  # the right symbol of the pair goes, what follows moves up
            s[:, :-1] = np.take_along_axis(s, keep, 1)
            s[:, -1] = EMPTY
            c[:, :-1], m[:, :-1] = np.take_along_axis(c, keep[:, :-1], 1), np.take_along_axis(m, keep[:, :-1], 1)
            c[:, -1] = np.inf
            c[at, best], m[at, best] = self._pairs(s[at, best], s[at, best + 1])
            left = np.maximum(best - 1, 0)
            c_left, m_left = self._pairs(s[at, left], s[at, left + 1])
            c[at, left], m[at, left] = np.where(best > 0, c_left, c[at, left]), np.where(best > 0, m_left, m[at, left])
            rows[live], cost[live], into[live] = s, c, m
        return rows

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and piece of symbol pairs, infinite where they spell none: look-ups in an open hash table."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) << 32 | right, -2)
        slot = self._slot(key)
        while True:
            there = self.table[slot]
            go_on = (there != key) & (there != -1)
            if not go_on.any():
                break
            slot = np.where(go_on, (slot + 1) & (len(self.table) - 1), slot)
        hit = self.table[slot] == key
        return np.where(hit, self.table_cost[slot], np.inf), self.table_into[slot]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _index_pairs(self) -> None:
        """Symbols of single characters, and the hash table of all pairs that spell a piece."""
        self.symbol = STRANGE - np.arange(0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.table, self.table_cost, self.table_into = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS, np.int32)
        found = {self.ids[p[:k]] << 32 | self.ids[p[k:]]: p for p in self.ids for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        if len(found) * 2 > len(self.table):
            raise ValueError("the vocabulary has too many pairs for its table")
        for slot, (key, p) in zip(self._slot(np.fromiter(found, np.int64, len(found))).tolist(), found.items()):
            while self.table[slot] != -1:
                slot = (slot + 1) & (len(self.table) - 1)
            self.table[slot], self.table_cost[slot], self.table_into[slot] = key, self.cost[p], self.ids[p]

    def _long(self, chunk: str) -> list[str]:
        cost = self.cost
        symbols, n = list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (c := cost.get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (c, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != pair or after[i] != j:
                continue
            symbols[i], symbols[j], after[i] = pair, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def check(self, texts: list[str]) -> None:
        """Compare whole texts with the library; any difference is an error."""
        for t, ids in zip(texts, self.sp.encode(texts, num_threads=1)):
            if self.encode(t) != ids:
                raise ValueError(f"agenda and library differ on {t!r}: {self.encode(t)} and {ids}")

    @staticmethod
    def marked(text: str, cut: str) -> str:
        """The text with its marks, cut before every chunk: words with the marks before them, line ends, starts of lines."""
        if MARK in text or "  " in text or text[:1] == " ":
            return cut.join(re.findall(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n", MARK + text.replace(" ", MARK)))
        return MARK + text.replace("\n", f"{cut}\n{cut}").replace(" ", cut + MARK)

    def encode_batch(self, texts: list[str | None], known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, and the offset at which each text begins (with the end).

        Arrow splits the batch into chunks, at a character that no text holds, and numbers the different
        ones; only these are looked up or encoded.
        """
        known = Known(self) if known is None else known
        cut = next(c for c in map(chr, (*range(9), *range(0xE000, 0xF8FF), *range(0xF0000, 0x10FFFE))) if not any(t and c in t for t in texts))
        parts = pc.split_pattern(pa.array([self.marked(t, cut) if t else None for t in texts], pa.string()), cut)
        bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        numbered = pc.dictionary_encode(parts.flatten())
        found = known.look_up(numbered.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        number = numbered.indices.to_numpy()
        each, start = size[number], (np.cumsum(size) - size)[number]
        ends = np.cumsum(each)
        ids = flat[np.repeat(start - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[bounds]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return self.encode_batch([text])[0].tolist()

    # -- decoding ---------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids)."""
        return self.sp.decode(ids)


class Known(dict):
    """Encoded chunks. What a batch adds is encoded together and checked against the library; a difference is an error."""

    def __init__(self, codec: MergeCodec) -> None:
        super().__init__({"": b""})
        self.codec = codec

    def look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.get, chunks))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(fresh), FRESH):
            some = fresh[at : at + FRESH]
            new = [chunks[i] for i in some]
            for i, c, ids in zip(some, new, self._checked(new, self.codec.encode_chunks(new))):
                found[i] = ids
                if len(c) <= CHUNK_CHARS:
                    self[c] = ids
        if len(self) > KEPT:
            self.clear()
            self[""] = b""
        return found

    def _checked(self, chunks: list[str], own: list[bytes]) -> list[bytes]:
        lib = self.codec.sp
        lead = len(lib.encode("\n"))
        for c, ids, theirs in zip(chunks, own, lib.encode(["\n" + c.replace(MARK, " ") for c in chunks], num_threads=1)):
            if array("i", theirs[lead:]).tobytes() != ids:
                raise ValueError(f"agenda and library differ on {c!r}: {array('i', ids).tolist()} and {theirs[lead:]}")
        return own


#: What encode_documents can return.
RESULTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


@lru_cache(maxsize=2)
def loaded(model_file: str) -> tuple[MergeCodec, Known]:
    """One codec and one table of chunks for all tasks of a Python worker."""
    codec = MergeCodec(model_file)
    gc.freeze()  # the tables hold no cycles: keep the collector from walking them
    gc.set_threshold(200_000, 50, 50)
    return codec, Known(codec)


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most BATCH rows and about BATCH_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, side="right"))
        end = min(max(end, at + 1), at + BATCH)
        yield batch.slice(at, end - at)
        at = end


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None, results: tuple[str, ...] = ("ids", "decoded"), prefix: str = "") -> DataFrame:
    """docs[keep] plus results, their names after prefix: ids array<int>, n_tokens long, decoded string, ids_sha256 and decoded_sha256.

    Digests are made where the ids are, so that neither ids nor texts travel for them.
    """
    names = [prefix + r for r in results]
    keep = carried(docs, tuple(names), text) if keep is None else keep
    source = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(n, RESULTS[r]) for n, r in zip(names, results)]])

    def one(codec: MergeCodec, flat: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        out: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(bounds), pa.int64())}
        if "ids" in results:
            out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        each = [flat[i:j].tolist() for i, j in zip(bounds, bounds[1:])]
        if "ids_sha256" in results:
            out["ids_sha256"] = pa.array([hashlib.sha256(",".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest() for ids in each], pa.string())
        if "decoded" in results:
            out["decoded"] = pa.array(map(codec.decode, each), pa.string())
        if "decoded_sha256" in results:
            out["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(ids).encode()).hexdigest() for ids in each], pa.string())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = loaded(model_file)
        for batch in batches:
            for part in parts_of(batch, len(keep)):
                found = one(codec, *codec.encode_batch(part.column(len(keep)).to_pylist(), known))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[found[r] for r in results]], names=schema.names)
            tidy()

    return source.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode_documents reduced to n_tokens, ids_sha256 and decoded_sha256 inside the same task."""
    return encode_documents(docs, model_file, text, keep, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Every whole document encoded and decoded again; digests of both."""
    if model_file is None:
        import public_tokenizers

        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file)


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE: dict[str, str] = {}
