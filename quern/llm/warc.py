"""WARC: pages to archives, monolithic gzip streams normalised to one member a record, with an index.

Archives are rows (archive, data) of a written table, so they live in any store that Spark reaches;
`export` lays them down as .warc.gz files where a file system is mounted.

1. `written`: a response or revisit record a page, many records in one gzip stream an archive, as
   careless crawlers leave them: the whole stream must be inflated to reach any record.
2. `normalised`: inflates such a stream once, front to back, and writes every record as a member of
   its own, with the side table archive, offset, length, record id, type, digest.
3. `read`: fetches members by the index's offsets and parses them.

Memory a task: one archive (ARCHIVE bytes of records, or one larger record).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stage, texts

ARCHIVE = 16 << 20
VERSION = b"WARC/1.1"
#: Fixed so that archives of equal pages are equal bytes.
DATE = b"2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no payload, but its digest and length, and the record it refers to."""
    head = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", b"<urn:page:%s>" % str(page_id).encode()),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", " ".join((url or "").split()).encode()),
        (b"WARC-Payload-Digest", b"sha1:" + payload_digest(payload).encode()),
        (b"WARC-Payload-Length", str(len(payload)).encode()),
        (b"Content-Type", b"application/http;msgtype=response"),
    ]
    if refers_to is not None:
        head += [(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", b"<urn:page:%d>" % refers_to)]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body += payload if refers_to is None else b""
    head.append((b"Content-Length", str(len(body)).encode()))
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + body + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, raw record) of each record of an inflated stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        raw, head = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
            k, _, v = line.partition(b":")
            head[k.strip().decode().lower()] = v.strip().decode()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield head, block, b"".join((*raw, b"\r\n", block, b"\r\n\r\n"))


def normalise(data: bytes) -> tuple[bytes, list[tuple[int, int, dict[str, str]]]]:
    """A monolithic gzip stream as one member a record; (offset, length, headers) of each member."""
    out, index = io.BytesIO(), []
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        for head, _, raw in parse(io.BufferedReader(stream, 1 << 20)):
            at = out.tell()
            out.write(gzip.compress(raw, 6, mtime=0))
            index.append((at, out.tell() - at, head))
    return out.getvalue(), index


def _write(batches):
    """(archive, data): gzip streams of about ARCHIVE bytes of records."""

    def closed(parts, first):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = b"".join([*(packer.compress(p) for p in parts), packer.flush()])
        name = f"{first}-{hashlib.sha256(data).hexdigest()[:16]}"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "data"])

    parts, size, first = [], 0, None
    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for i, u, t, r in zip(ids, urls, texts(batch.column(2)), refers, strict=True):
            parts.append(record(i, u, t or b"", r))
            first = i if first is None else first
            size += len(parts[-1])
            if size >= ARCHIVE:
                yield closed(parts, first)
                parts, size, first = [], 0, None
    if parts:
        yield closed(parts, first)


def _normalise(batches):
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, index = normalise(data)
            entries = [{"offset": o, "length": n, "record_id": h["warc-record-id"], "type": h["warc-type"], "digest": h["warc-payload-digest"]} for o, n, h in index]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary()), pa.array([entries], _INDEX)], ["archive", "data", "entries"])


_INDEX = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("digest", pa.string())]))


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "None") else None


def _read(batches):
    for batch in batches:
        for data, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for e in entries:
                member = gzip.decompress(data[e["offset"] : e["offset"] + e["length"]])
                ((head, block, _),) = parse(io.BytesIO(member))
                digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"])
                payload = block.partition(b"\r\n\r\n")[2]
                if head["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                    raise ValueError(f"{head['warc-record-id']}: the payload is not what its header says")
                rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], _page(head.get("warc-refers-to")), payload.decode() if head["warc-type"] == "response" else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def written(pages: DataFrame) -> DataFrame:
    """(archive, data) of pages (page_id, url, html), as a table in the shared folder.

    A null html is an empty payload. Of equal payloads, empty ones too, the smallest page_id is the
    response and the others revisit it; rows that repeat with the page_id of a response are
    responses too. A null page_id comes after all others; pages with one are responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    first = own.where("page_id is not null").groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    linked = own.join(first, ["digest", "size"], "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return stage(linked.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write, "archive string, data binary"), "warc")


def normalised(archives: DataFrame) -> DataFrame:
    """(archive, data, entries): members of their own and the side index, as a table in the shared folder."""
    schema = "archive string, data binary, entries array<struct<offset: long, length: long, record_id: string, type: string, digest: string>>"
    return stage(archives.select("archive", "data").mapInArrow(_normalise, schema), "members")


def read(archives: DataFrame) -> DataFrame:
    """One row a record, read through the index; payload is null for revisits."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return archives.select("data", "entries").mapInArrow(_read, schema)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Writes each archive as <archive>.warc.gz and its index as <archive>.cdx.tsv to a mounted folder,
    one archive at a time."""
    import os

    names = []
    for r in archives.toLocalIterator():
        path = os.path.join(folder, f"{r['archive']}.warc.gz")
        with open(path, "wb") as f:
            f.write(r["data"])
        with open(path.removesuffix(".warc.gz") + ".cdx.tsv", "w") as f:
            f.writelines(f"{e['offset']}\t{e['length']}\t{e['record_id']}\t{e['type']}\t{e['digest']}\n" for e in r["entries"])
        names.append(path)
    return names


def page_records(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from the normalised archives."""
    return read(normalised(written(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
