"""WARC archives: deduplicating writer and salvage reader.

Writing: every row becomes one record, a gzip member of its own. Of rows with equal
payloads of at least MIN_PAYLOAD bytes, the one with the smallest id holds the payload
(response); the others are revisit records that name it and keep the HTTP header only.
Records are gathered into archives of bounded size inside each task; archives are rows
(archive, content binary), so any store that Spark writes can hold them.

Reading: the reader goes from record to record. When a check fails (gzip checksum or
stream, version line, header, lengths, block or payload digest) it looks for the next
valid gzip member or version line, goes on there, and logs the bytes in between as a
quarantined gap (archive, offset, length, reason). Later records are not lost.

Defined results: null payloads count as empty; null ids are written as empty ids and
read back as null (as the representative of a group they come last); rows that repeat
an id are records of their own (of equal ids with equal payloads, the one with the least
hash of its url is the response; rows equal in id, url and payload all are); further
columns of the input play no part, whatever their names; an empty table gives no archives.
Payloads of any length are written whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import table, written

MIN_PAYLOAD, ARCHIVE_BYTES = 100, 4 << 20
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        # a url cannot break the header: its control characters and its percent signs are escaped
        f"WARC-Target-URI: {'' if url is None else re.sub('[%\\x00-\\x20\\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all rows: archive string, content binary."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.length("payload"), "uh": F.xxhash64("url")})
    # partial minima before the shuffle: one row for each digest and task
    first = rows.where(F.col("n") >= MIN_PAYLOAD).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "uh")).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where("copies > 1").select(F.col("digest").alias("fd"), F.col("first.id").alias("refers_to"), F.col("first.uh").alias("fu"))
    linked = rows.join(first, (F.col("digest") == F.col("fd")) & (F.col("n") >= MIN_PAYLOAD), "left")
    same = F.col("id").eqNullSafe(F.col("refers_to")) & F.col("uh").eqNullSafe(F.col("fu"))
    linked = linked.withColumn("revisit", F.col("fd").isNotNull() & ~same).select("id", "url", "payload", "digest", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24]]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(member(record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return linked.mapInArrow(run, "archive string, content binary")


class Bad(ValueError):
    """A record that fails a check."""


@dataclass
class Salvage:
    """Records of one archive, and the byte gaps that held none."""

    content: bytes
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def _inflate(self, at: int) -> tuple[bytes, int]:
        d, view, out = zlib.decompressobj(31), memoryview(self.content), []
        try:
            while not d.eof and at < len(view):  # in pieces: what follows the member is not copied
                out.append(d.decompress(view[at : at + 65536]))
                at = min(at + 65536, len(view))
        except zlib.error as e:
            raise Bad(f"gzip: {e}") from e
        if not d.eof:
            raise Bad("gzip: the member does not end")
        return b"".join(out), at - len(d.unused_data)

    @staticmethod
    def parse(data: bytes, at: int, whole: bool) -> tuple[dict, int]:
        """Record at a version line and the offset behind it. whole: it must fill data."""
        end = data.find(b"\r\n\r\n", at)
        if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
            raise Bad("no version line")
        if end < 0:
            raise Bad("the header does not end")
        if not all(re.match(rb"[!-9;-~]+:|[ \t]", x) for x in data[at:end].split(b"\r\n")[1:]):
            raise Bad("a header line is broken")
        head = dict(re.findall(r"(?m)^([A-Za-z-]+): ?(.*?)\r?$", data[at : end + 2].decode("utf-8", "replace")))
        names = re.findall(rb"(?m)^([!-9;-~]+):", data[at:end].lower())
        if len(names) - names.count(b"warc-concurrent-to") != len(set(names) - {b"warc-concurrent-to"}) or re.search(rb"WARC/1\.", data[at + 5 : end]):
            raise Bad("the header runs into another one")
        length = head.get("Content-Length", "")
        if not re.fullmatch(r"[0-9]+", length):
            raise Bad("no Content-Length")
        begin, stop = end + 4, end + 4 + int(length)
        block = data[begin:stop]
        if data[stop : stop + 4] != b"\r\n\r\n" or whole and stop + 4 != len(data):
            raise Bad("the block's length is wrong")
        if (given := head.get("WARC-Block-Digest")) and given.removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
            raise Bad("block digest")
        http, mark, payload = block.partition(b"\r\n\r\n")
        declared = re.search(rb"(?im)^content-length: *([0-9]+)", http)
        kind, digest = head.get("WARC-Type", ""), head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        if kind not in ("response", "revisit") or not mark or not declared:
            raise Bad("not a response or revisit record")
        if kind == "response" and (len(payload) != int(declared[1]) or hashlib.sha256(payload).hexdigest() != digest):
            raise Bad("payload digest")
        if not re.fullmatch(r"<[!-;=?-~]+>", head.get("WARC-Record-ID", "")):
            raise Bad("record id")
        number = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get(k, ""))) else None
        return {
            "page_id": number("WARC-Record-ID"), "url": re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), head.get("WARC-Target-URI", "")), "record_type": kind, "refers_to": number("WARC-Refers-To"),
            "payload_bytes": int(declared[1]), "payload_digest": digest, "payload": payload if kind == "response" else None,
        }, stop + 4

    def records(self) -> Iterator[dict]:
        """Valid records in order; fills gaps."""
        at, lost, why = 0, None, ""
        data = self.content
        while at < len(data):
            try:
                if data.startswith(GZIP, at):
                    inner, end = self._inflate(at)
                    record, _ = self.parse(inner, 0, True)
                else:
                    record, end = self.parse(data, at, False)
            except Bad as e:
                if lost is None:
                    lost, why = at, str(e)
                found = [x for x in (data.find(GZIP, at + 1), data.find(b"WARC/1.", at + 1)) if x >= 0]
                at = min(found, default=len(data))
                continue
            if lost is not None:
                self.gaps.append((lost, at - lost, why))
                lost = None
            yield record | {"offset": at}
            at = end
        if lost is not None:
            self.gaps.append((lost, len(data) - lost, why))


_RECORD = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_bytes long, gap_reason string"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives (archive, content), and a row with gap_bytes and gap_reason for every quarantined gap."""
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                salvage, rows = Salvage(content.as_py() or b""), []
                for record in salvage.records():
                    rows.append(record | {"archive": name} | ({} if payloads else {"payload": None}))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
                        rows = []
                rows += [{"archive": name, "offset": at, "gap_bytes": n, "gap_reason": why} for at, n, why in salvage.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)

    return archives.select("archive", "content").mapInArrow(run, _RECORD)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files (*.warc, *.warc.gz) of a folder in any store that Spark reads, as archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select(F.col("path").alias("archive"), "content")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back."""
    archives = written(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "warc")
    seen = read_archives(archives, payloads=False)
    # archives just written have no gaps: one is an error, not a row less
    gap = F.raise_error(F.concat(F.lit("gap in archive "), F.col("archive"), F.lit(": "), F.col("gap_reason"))).cast("long")
    seen = seen.withColumn("page_id", F.when(F.col("gap_reason").isNotNull(), gap).otherwise(F.col("page_id")))
    return seen.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLE = {
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as n from pages),
f as (select html, min(page_id) as first from p where n >= 100 group by html)
select p.page_id, p.n as payload_bytes, sha256(p.html) as payload_digest,
  case when f.first is not null and f.first <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> p.page_id then f.first end as refers_to
from p left join f on p.html = f.html and p.n >= 100
""",
}
