"""Token ids in files of compressed bit planes, with an index of chunks for random access.

*Ids.* Every whole text is encoded with a tokenizer file of the tokenizers library and closed
with an end id. Where the tokenizer drops white space and cuts words by one pattern (`by_words`), a text
is split at ASCII blanks and words are read from a bounded table of packed ids; a new word is cut
by the file's own pattern and merged by the library's model, or, if it has other characters than
PLAIN or an added token, encoded by the library. Texts under other files go to the library whole.

*Order.* Documents are dealt by ranges of doc_id and sorted inside a range; a document's start is
the sum of the ranges before, of the files before in its range, and of the documents before in its
file. Only sizes of ranges meet in one place, never ids.

*File.* Ids of consecutive documents, end to end, in blocks of BLOCK ids. A block is transposed
into bit planes (plane i holds bit i of all its ids) or byte planes, each compressed by zstandard
as a chunk with a checksum. Layout: magic, chunks, table of documents (zstandard), index of chunks
(offset, size, checksum of each plane of each block), fixed-size tail that tells where they are.
`TokenFile` reads any range of ids by decompressing only the blocks it touches.
Files are rows (part, file, bytes) of a table in the shared folder, FILE ids each or one longer document.

Defined results: null texts count as empty: the end id alone. Null doc_ids come first. Rows with
the same doc_id follow each other by a hash of the text; rows that repeat are rows of their own.
Texts of any length are encoded whole; a document is never cut between files. Added tokens inside
a text are taken as the library does by default. A damaged chunk, table or tail is a PlaneError; a
file that is missing or stands twice fails the read. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import dropped, table, written

END, LEVEL = 2, 3
#: BLOCK: ids of a block. FILE: ids after which a file is closed at the next document's end. WORDS, WORD_CHARS: words (and pieces of words) that a task remembers, and the longest of them.
BLOCK, FILE, WORDS, WORD_CHARS = 1 << 16, 1 << 18, 500_000, 40
#: Ids that a range of doc_ids holds about: the most, and the least as long as there are fewer ranges than shuffle partitions.
RANGE, LEAST_RANGE = 1 << 27, 1 << 20
#: Words that need no library but for its merges: ASCII, Latin-1 and Latin Extended-A without the one letter whose lower case is two characters; none of these is composed or cut otherwise by any version of Unicode.
PLAIN = "[!-~\u00a1-\u012f\u0131-\u017f\n]+"
MAGIC, TAIL = b"IDPLANE1", struct.Struct("<BBBxIQIIQI")  # bits of an id, planes, whether they are of bits, block, ids, documents, blocks, ids before, bytes of the table of documents; a checksum of tables and tail and the magic follow


class PlaneError(ValueError):
    """A file of planes that fails a check."""


def to_planes(ids: np.ndarray, bits: int, of_bits: bool) -> list[bytes]:
    """Planes of the ids of one block: bit 0 first, or the lowest byte."""
    width = -(-bits // 8)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not of_bits:
        return [raw[:, i].tobytes() for i in range(width)]
    split = np.unpackbits(raw.T, axis=None, bitorder="little").reshape(width, -1, 8)
    return [np.packbits(split[i >> 3, :, i & 7], bitorder="little").tobytes() for i in range(bits)]


def from_planes(planes: list[bytes], n: int, of_bits: bool) -> np.ndarray:
    """The n ids (uint32) of a block."""
    raw = np.zeros((4, n), np.uint8)
    for i, plane in enumerate(planes):
        data = np.frombuffer(plane, np.uint8)
        if of_bits:
            raw[i >> 3] |= np.unpackbits(data, count=n, bitorder="little") << np.uint8(i & 7)
        else:
            raw[i] = data
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def write_file(ids: np.ndarray, keys: list[int | None], sizes: np.ndarray, start: int = 0, block: int = BLOCK, of_bits: bool = True, level: int = LEVEL) -> bytes:
    """One file: ids of documents with these keys and sizes, end to end; start: ids of the part before the file."""
    ids = np.asarray(ids, np.uint32)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    pack = zstandard.ZstdCompressor(level=level)
    out, index, at = [MAGIC], [], len(MAGIC)
    for low in range(0, len(ids), block):
        for plane in to_planes(ids[low : low + block], bits, of_bits):
            chunk = pack.compress(plane)
            index.append((at, len(chunk), zlib.crc32(chunk)))
            out.append(chunk)
            at += len(chunk)
    known = np.array([k is not None for k in keys], np.uint8)
    docs = pack.compress(np.array([k or 0 for k in keys], "<i8").tobytes() + known.tobytes() + np.asarray(sizes, "<i8").tobytes())
    table_ = b"".join(struct.pack("<QII", *x) for x in index)
    tail = TAIL.pack(bits, bits if of_bits else -(-bits // 8), of_bits, block, len(ids), len(keys), -(-len(ids) // block), start, len(docs))
    rest = docs + table_ + tail
    return b"".join([*out, rest, struct.pack("<I", zlib.crc32(rest)), MAGIC])


class TokenFile:
    """Reader of one file; checks every part that it reads."""

    def __init__(self, data: bytes) -> None:
        tail = len(data) - TAIL.size - 12
        if tail < len(MAGIC) or data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
            raise PlaneError("no file of planes")
        self.bits, self.planes, self.of_bits, self.block, self.n_ids, self.n_docs, self.n_blocks, self.start, packed = TAIL.unpack_from(data, tail)
        chunks = self.n_blocks * self.planes
        index = tail - 16 * chunks
        docs = index - packed
        if docs < len(MAGIC) or zlib.crc32(data[docs : tail + TAIL.size]) != struct.unpack_from("<I", data, tail + TAIL.size)[0]:
            raise PlaneError("the file's tail or tables are damaged")
        self.data = memoryview(data)
        self.index = np.frombuffer(data, np.dtype([("at", "<u8"), ("size", "<u4"), ("crc", "<u4")]), chunks, index).reshape(self.n_blocks, self.planes)
        raw = zstandard.ZstdDecompressor().decompress(data[docs:index], max_output_size=max(1, 17 * self.n_docs))
        keys, known, sizes = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, 8 * self.n_docs), np.frombuffer(raw, "<i8", self.n_docs, 9 * self.n_docs)
        self.keys, self.sizes = [int(k) if is_known else None for k, is_known in zip(keys, known)], sizes
        if int(sizes.sum()) != self.n_ids or self.n_blocks != -(-self.n_ids // self.block):
            raise PlaneError("sizes of documents and file do not agree")

    def read_block(self, b: int) -> np.ndarray:
        n = min(self.block, self.n_ids - b * self.block)
        unpack, planes, width = zstandard.ZstdDecompressor(), [], -(-n // 8) if self.of_bits else n
        for at, size, crc in self.index[b].tolist():
            chunk = self.data[at : at + size]
            if zlib.crc32(chunk) != crc:
                raise PlaneError(f"checksum of block {b}")
            planes.append(unpack.decompress(chunk, max_output_size=width))
            if len(planes[-1]) != width:
                raise PlaneError(f"length of a plane of block {b}")
        return from_planes(planes, n, bool(self.of_bits))

    def read(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids low to high of the file, from the blocks that hold them."""
        high = self.n_ids if high is None else min(high, self.n_ids)
        if low >= high:
            return np.zeros(0, np.uint32)
        first = low // self.block
        return np.concatenate([self.read_block(b) for b in range(first, (high - 1) // self.block + 1)])[low - first * self.block : high - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start in the file and ids of each document, in order; one block and what is open of a document are held at a time."""
        at, have, b, parts = 0, 0, 0, [np.zeros(0, np.uint32)]
        for key, size in zip(self.keys, self.sizes.tolist()):
            while have < size:
                parts.append(self.read_block(b))
                have += len(parts[-1])
                b += 1
            ids = np.concatenate(parts) if len(parts) != 1 else parts[0]
            yield key, at, ids[:size]
            parts, have, at = [ids[size:]], have - size, at + size


class Encoder:
    """Ids of texts as packed little-endian numbers, equal to the library's."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_json)
        self.library.no_padding()
        self.library.no_truncation()
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        spec = json.loads(self.library.to_str())
        self.by_words = by_words(spec)
        if self.by_words:
            self.model, self.parts = self.library.model, regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
            self.plain = re.compile(PLAIN)
            self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
            shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves as characters; the others follow from 256 on
            self.bytes_as = dict(zip((x for x in range(256) if x not in shown), range(256, 512)))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed_pieces(self, found: list[str]) -> Iterator[bytes]:
        for piece in set(found).difference(self.pieces):
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes_as)
            self.pieces[piece] = array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes() if piece != "\n" else b""
        return map(self.pieces.__getitem__, found)

    def _learn(self, new: list[str]) -> None:
        """Put the ids of these words into the table."""
        other: list[str] = []
        if not self.plain.fullmatch(text := "\n".join(new)) or self.added.search(text):
            other = [w for w in new if not self.plain.fullmatch(w) or self.added.search(w)]
            new = list(set(new).difference(other))
        letters = [w for w in new if w.isalpha()]  # one piece each
        self.words.update(zip(letters, self._packed_pieces("\n".join(letters).lower().split("\n") if letters else [])))
        mixed = [w for w in new if not w.isalpha()]
        found = self.parts.findall("\n".join(mixed).lower())  # line feeds end the words
        packed, at = list(self._packed_pieces(found)), 0
        ends = [i for i, piece in enumerate(found) if piece == "\n"]
        for word, end in zip(mixed, [*ends, len(found)]):
            self.words[word] = b"".join(packed[at:end])
            at = end + 1
        self.words.update(zip(other, self._by_library(other)))

    def _ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of texts: the different words are looked up once, then gathered."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(words).difference(self.words)
        if len(self.pieces) > WORDS:
            self.pieces.clear()
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = set(words)
        self._learn(list(new))
        packed = list(map(self.words.__getitem__, words))
        for w in new:
            if len(w) > WORD_CHARS:
                del self.words[w]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        of = coded.indices.to_numpy()
        flat, first, n = np.frombuffer(b"".join(packed), self.kind), np.cumsum(sizes) - sizes, sizes[of]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(first[of] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return (ids[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of texts in UTF-8."""
        if not self.by_words:
            return self._by_library([t.decode() for t in texts])
        return [ids.tobytes() for some in pieces(texts) for ids in self._ids(some)]


def by_words(spec: dict) -> bool:
    """Whether a text's ids are those of its words between ASCII blanks, pieced by one pattern: composed, blanks made one, lower case; cut by a pattern that takes no blanks; bytes as characters."""
    steps = lambda key, inner: (spec.get(key) or {}).get(inner) or []
    normal, cuts = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    shape = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
    if not shape or normal[1]["pattern"] != {"Regex": r"\s+"} or normal[1]["content"] != " ":
        return False
    cut, level = cuts
    drops = cut["invert"] and cut["behavior"] == "Removed" and cut["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") and not level["add_prefix_space"] and not level["use_regex"]
    return bool(drops) and all(not t["normalized"] and not t["single_word"] and not t["content"].split()[1:] for t in spec["added_tokens"])


def pieces(texts: list[bytes], most: int = 8 << 20) -> Iterator[list[bytes]]:
    """The texts in order, some together that have about `most` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> Encoder:
    return Encoder(tokenizer_json)


def encode_documents(docs: DataFrame, tokenizer_json: str, end: int | None = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tie (hash of the text), n_ids (with the end id) and ids (little-endian unsigned numbers of 16 or 32 bits, zstandard)."""
    source = docs.select(docs[doc_id].cast("long"), F.xxhash64(docs[text]), docs[text].cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(tokenizer_json), zstandard.ZstdCompressor(level=1)
        close = b"" if end is None else array(enc.kind, [end]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                part = batch.slice(at, 2500)
                ids = [x + close for x in enc.encode([t or b"" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array([pack.compress(x) for x in ids], pa.binary())], names=["doc_id", "tie", "n_ids", "ids"])

    return source.mapInArrow(run, "doc_id long, tie long, n_ids long, ids binary")


def _unpacked(n: int, packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, 4 * n))
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def n_ids_of(encoded: DataFrame) -> int:
    return encoded.agg(F.sum("n_ids")).first()[0] or 0


def write_planes(encoded: DataFrame, total: int, of_bits: bool = True, block: int = BLOCK, file: int = FILE) -> DataFrame:
    """Files of the encoded documents (a table of encode_documents that is written already, with so many ids), in ascending doc_id: part, file, n_ids, bytes."""
    usual = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // RANGE), min(usual, -(-total // LEAST_RANGE)))
    # the row's number only tells rows with equal ids and texts apart, so that they may stand in several ranges
    numbered = encoded.withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("row")]
    ranged = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts_, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = write_file(np.concatenate(parts_), keys, np.array(sizes, np.int64), before, block, of_bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "file", "n_ids", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, size = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                keys.append(key)
                sizes.append(size)
                parts_.append(_unpacked(size, batch.column(2)[i].as_py()))
                n += size
                if n >= file:
                    yield close()
                    before, number = before + n, number + 1
                    keys, sizes, parts_, n = [], [], [], 0
        if keys:
            yield close()

    return ranged.mapInArrow(run, "part int, file long, n_ids long, bytes binary")


def manifest(files: DataFrame, total: int | None = None) -> DataFrame:
    """part, n_files, n_ids and base (ids of all parts before): one row for each range. An error if a file is not there once, or, with total, if ids are missing."""
    sums = files.groupBy("part").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("file").alias("different"), F.max("file").alias("last"), F.sum("n_ids").alias("n_ids"))
    full = F.lit(True) if total is None else F.sum("n_ids").over(W.partitionBy()) == total
    whole = F.assert_true(full & (F.col("n_files") == F.col("different")) & (F.col("last") + 1 == F.col("n_files")), "a file of token ids is missing or stands twice")
    base = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select("part", "n_files", "n_ids", base.alias("base"), whole.alias("wrong")).where("wrong IS NULL").drop("wrong")


def read_planes(files: DataFrame, total: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files, all chunks checked; total: ids that there must be."""
    ranges = manifest(files.drop("bytes"), total)  # RANGE ids a row: small beside the files by construction
    source = files.join(F.broadcast(ranges.select("part", "base")), "part").select("base", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, data = batch.column(0)[i].as_py(), TokenFile(batch.column(1)[i].as_py())
                rows = [(key, base + data.start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in data.documents()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return source.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_planes(spark: SparkSession, sf_dir: str, tokenizer_json: str | None = None) -> DataFrame:
    """Ids of every whole document written as bit planes in ascending doc_id, and read back."""
    if tokenizer_json is None:
        import public_tokenizers

        tokenizer_json = public_tokenizers.path("word_bpe_49k.json")
    encoded = written(encode_documents(table(spark, sf_dir, "documents"), tokenizer_json), "encoded")
    total = n_ids_of(encoded)
    files = written(write_planes(encoded, total), "planes")
    dropped(spark, encoded)
    return read_planes(files, total)


QUERIES = {"op12_token_planes": op12_token_planes}
ORACLE: dict[str, str] = {}
