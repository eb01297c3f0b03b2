"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader needs no index: a task scans its byte range for the gzip magic, takes
a candidate for a member only if its start inflates to a WARC header, and owns the records that begin inside its range,
reading past its end where the last one does. From a member's end it goes on without a scan.

Of records with equal payloads of at least `revisit_bytes`, the one with the largest page_id is a response, the others
revisit it; their headers keep the length and the digest of the full payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import durable, new_dir, ready
from ._files import NewFile, opened

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'null' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(URN)
    return int(name) if name.lstrip("-").isdigit() else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit of refers_to, unless that is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages; returns a row per file: path, size.

    Null html is an empty payload. Rows that share the largest id of a payload are all responses; null ids are smaller than
    any other, and revisit like others unless all ids are null. An empty table writes no file.
    """
    spark = ready(pages.sparkSession)
    folder = folder or new_dir(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    largest = durable(rows.where(F.octet_length("html") >= revisit_bytes).select("page_id", key.alias("key")).groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("key", "best"))
    rows = rows.withColumn("key", key).join(largest, "key", "left")
    other = F.when(~F.coalesce(F.col("page_id"), F.col("best") - 1).eqNullSafe(F.col("best")), F.col("best"))
    rows = rows.select("page_id", "url", "html", other.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            for k in range(len(batch)):
                file = file or NewFile(uri)
                own, url, payload, refers = (c[k].as_py() for c in batch.columns)
                file.write(member(own, url, payload.encode(), refers, date))
        if file:
            file.close()
            yield pa.record_batch([pa.array([uri]), pa.array([file.size], pa.int64())], names=["path", "size"])

    return durable(rows.mapInArrow(run, "path string, size long"))


class _Range:
    """A file's bytes from `start` on, read as far as they are asked for, and let go behind."""

    def __init__(self, file, start: int, size: int, chunk: int) -> None:
        self.file, self.at, self.size, self.chunk, self.data = file, start, size, chunk, b""

    def upto(self, end: int) -> None:
        have = self.at + len(self.data)
        if have < min(end, self.size):
            self.file.seek(have)
            self.data += self.file.read(min(self.size, max(end, have + self.chunk)) - have)

    def drop(self, to: int) -> None:
        if to > self.at:
            self.data = self.data[to - self.at :]
            self.at = to


def _inflate(source: _Range, pos: int) -> tuple[bytes, int] | None:
    """The member at pos and its end, or None if there is none that holds a WARC record."""
    source.upto(pos + 4096)
    tool = zlib.decompressobj(31)
    try:
        out = [tool.decompress(source.data[pos - source.at : pos - source.at + 4096], 1 << 16)]
        if not out[0].startswith(b"WARC/"):
            return None
        at = pos + 4096
        rest = tool.unconsumed_tail
        while not tool.eof:
            if not rest:
                source.upto(at + 1)
                rest = source.data[at - source.at : at - source.at + source.chunk]
                at += len(rest)
                if not rest:
                    return None
            out.append(tool.decompress(rest))
            rest = tool.unconsumed_tail
    except zlib.error:
        return None
    return b"".join(out), min(at, source.size) - len(tool.unused_data)


def records_in(uri: str, start: int, end: int, size: int, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that begin in [start, end)."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        source, pos = _Range(file, start, size, chunk), start
        while pos < end:
            source.drop(pos)
            source.upto(min(end, pos + chunk) + len(MAGIC) - 1)
            found = source.data.find(MAGIC, pos - source.at)
            if found < 0:
                pos = max(pos + 1, source.at + len(source.data) - len(MAGIC) + 1)
                continue
            pos = source.at + found
            if pos >= end:
                return
            if (x := _inflate(source, pos)) is None:
                pos += 1
                continue
            yield pos, x[0]
            pos = x[1]


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers (lower-case names) of a record and of its HTTP message, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_warc(files: DataFrame, split: int = 1 << 23, with_payload: bool = False) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, at (and payload).

    A response's length and digest are those of the payload as read, a revisit's those that its headers keep. What is no
    WARC member is passed over. A response whose payload does not have its digest raises an error.
    """
    ready(files.sparkSession)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.select("path", "size", starts.alias("start")).withColumn("end", F.least(F.col("start") + split, F.col("size")))
    n = max(1, ranges.count())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "at"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def rows_of(uri: str, size: int, start: int, end: int) -> Iterator[tuple]:
        for at, record in records_in(uri, start, end, size):
            fields, http, payload = parse(record)
            kind = fields.get("warc-type")
            said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            length = int(http.get("content-length", len(payload)))
            if kind == "response":
                length = len(payload)
                if said and digest(payload) != said:
                    raise ValueError(f"{uri} at {at}: the payload does not have its digest")
                said = digest(payload)
            yield (_page_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), length, said, kind, _page_id(fields.get("warc-refers-to")), uri, at, *([payload] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows: list[tuple] = []
                for row in rows_of(x["path"], x["size"], x["start"], x["end"]):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, at long" + ", payload binary" * with_payload
    return ranges.repartition(min(n, 10_000), "path", "start").mapInArrow(run, schema)
