"""Media columns: lossless PNG in binary columns, read back with checks, and low-frequency cosine hashes.

The writer lays a payload out as an 8-bit grey image of fixed width and deflates it twice,
with plain rows and with rows filtered by None, Sub or Up (the smallest sum of absolute
residuals); the shorter form is stored. The reader
walks the chunks, tests every checksum, inflates and undoes any of the five filters in
numpy. The hash averages the image down to 32 x 32, takes the 8 x 8 lowest frequencies
of its two-dimensional cosine transform and marks the coefficients above their median
(64 bits; the constant term does not vote).

Defined results: null texts count as empty; the payload is the text's UTF-8 bytes and
blanks up to a positive multiple of the width; equal texts give equal values. A damaged
image raises MediaError in read_png; decode_media turns that into a null payload and the
reason in its error column. Texts of any length are stored whole; rows that repeat are rows
of their own; an empty table gives no rows. Further columns are carried along, but for those
with the names of results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import carried, table

WIDTH, LEVEL, SIDE, LOW = 192, 6, 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class MediaError(ValueError):
    """A stored image that fails a check."""


def payload_of(text: str | None, width: int = WIDTH) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // width)) * width, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """Grey 8-bit PNG whose rows are the payload: unfiltered or with filtered rows, whichever deflates to less."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    tried = (rows, rows - left, rows - above)
    pick = np.stack([np.minimum(x, np.uint8(0) - x).sum(axis=1, dtype=np.uint32) for x in tried]).argmin(axis=0).astype(np.uint8)
    plain, mixed = np.zeros((2, len(rows), width + 1), np.uint8)
    plain[:, 1:], mixed[:, 0] = rows, pick
    mixed[:, 1:] = np.where((pick == 0)[:, None], tried[0], np.where((pick == 1)[:, None], tried[1], tried[2]))
    packed = min((zlib.compress(x.tobytes(), level) for x in (plain, mixed)), key=len)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", packed) + _chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of every chunk; MediaError at a bad signature, length or checksum."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise MediaError(f"the file ends inside a chunk at byte {at}")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise MediaError(f"the file ends inside {kind!r}")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise MediaError(f"checksum of {kind!r} at byte {at}")
        yield kind, body
        at += 12 + n


def unfilter(filtered: np.ndarray, step: int = 1) -> np.ndarray:
    """Undo row filters. filtered: (rows, 1 + bytes), filter types first; step: bytes of a pixel."""
    kinds, rows = filtered[:, 0], filtered[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise MediaError(f"filter type {kinds.max()}")
    n, width = rows.shape
    sub = np.flatnonzero(kinds == 1)
    if sub.size:
        rows[sub] = np.cumsum(rows[sub].reshape(len(sub), -1, step), axis=1, dtype=np.uint8).reshape(len(sub), width)
    # a run of Up rows is a running sum below the row before it
    at = 0
    while at < n:
        end = at + 1
        if kinds[at] == 2:
            while end < n and kinds[end] == 2:
                end += 1
            if at:
                rows[at] += rows[at - 1]
            rows[at:end] = np.cumsum(rows[at:end], axis=0, dtype=np.uint8)
        elif kinds[at] > 2:
            above = rows[at - 1].astype(np.int32) if at else np.zeros(width, np.int32)
            rows[at] = (_average if kinds[at] == 3 else _paeth)(rows[at].astype(np.int32), above, step)
        at = end
    return rows


def _average(row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    for x in range(0, len(row), step):
        left = row[x - step : x] if x else 0
        row[x : x + step] = (row[x : x + step] + (left + above[x : x + step]) // 2) & 255
    return row


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    for x in range(0, len(row), step):
        a, c = (row[x - step : x], above[x - step : x]) if x else (np.zeros(step, np.int32),) * 2
        b = above[x : x + step]
        p = a + b - c
        da, db, dc = abs(p - a), abs(p - b), abs(p - c)
        row[x : x + step] = (row[x : x + step] + np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))) & 255
    return row


#: Samples of a pixel by colour type, 8-bit images: grey, colour, grey with alpha, colour with alpha.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """Samples as uint8 (rows, bytes of a row), after all checks. 8-bit, not interlaced, without palette."""
    head, packed = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise MediaError("no IHDR")
    width, height, depth, colour, *_, laced = head
    if depth != 8 or colour not in SAMPLES or laced:
        raise MediaError(f"depth {depth}, colour type {colour}, interlace {laced} are not supported")
    step = SAMPLES[colour]
    try:
        flat = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(flat) != height * (width * step + 1):
        raise MediaError(f"{len(flat)} bytes for {height} rows of {width}")
    return unfilter(np.frombuffer(flat, np.uint8).reshape(height, width * step + 1), step)


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


_BASE = _cosines(SIDE, LOW)


def cosine_hash(image: np.ndarray) -> bytes:
    """64-bit low-frequency hash of a grey image."""

    def shrink(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < SIDE:
            return x[np.arange(SIDE) * n // SIDE]
        edges = np.arange(SIDE) * n // SIDE
        return np.add.reduceat(x, edges, axis=0) / np.diff(np.append(edges, n))[:, None]

    small = shrink(shrink(image.astype(np.float64)).T).T
    low = (_BASE @ small @ _BASE.T).reshape(-1)
    low = np.round(low, 6)
    low[0] = np.median(low[1:])
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """docs[keep] plus n_bytes (long) and png (binary)."""
    keep = carried(docs, ("n_bytes", "png"), text) if keep is None else keep
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField("png", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(len(keep)).to_pylist()
                n = [len((t or "").encode()) for t in texts]
                png = [write_png(payload_of(t, width), width) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(png, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_media(media: DataFrame, png: str = "png", keep: list[str] | None = None) -> DataFrame:
    """media[keep] plus media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, cosine_hash (binary) and error."""
    kinds = {"media_bytes": T.LongType(), "media_sha256": T.StringType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "cosine_hash": T.BinaryType(), "error": T.StringType()}
    keep = carried(media, tuple(kinds), png) if keep is None else keep
    source = media.select(*keep, media[png].alias("__png"))
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(k, v) for k, v in kinds.items()]])
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def look(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("no media",)
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            image = read_png(data)
        except MediaError as e:
            return (*stored, None, None, None, None, str(e))
        payload = image.tobytes()
        return (*stored, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), cosine_hash(image), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [look(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)]], names=schema.names)

    return source.mapInArrow(run, schema)


def op9_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a PNG, read back and described."""
    media = encode_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seen = decode_media(media)
    # images just written have no damage: one that fails a check is an error, not a row of nulls
    bytes_ = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("stored image: "), F.col("error"))).cast("long")).otherwise(F.col("n_bytes"))
    return seen.withColumn("n_bytes", bytes_).selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "lower(hex(cosine_hash)) AS feature")


QUERIES = {"op9_media_png": op9_media_png}
ORACLE: dict[str, str] = {}
