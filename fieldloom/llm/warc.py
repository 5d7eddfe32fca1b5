"""WARC archives: written from pages, read back with segments put together and chunked framing undone.

Writing: equal payloads are found by hash; the one with the smallest id is a ``response`` record,
the others ``revisit`` it. A response block is an HTTP message in chunked framing; a block above
``SEGMENT`` bytes is cut, and its later parts are ``continuation`` records that name the first one
as origin. Tasks write archives of about ``ARCHIVE`` bytes into the shared folder, under another
name until whole, and return their paths, so only archives of tasks that ended well are read.

Reading: a task streams an archive, a gzip member at a time. Whole responses are decoded where they
are read. Segments are grouped by origin, ordered by number, and held against the total length that
the last one states; a record with a segment missing, doubled or of wrong length is an error, and so
is a payload whose digest differs from the header's. A group is one record, whatever its source.

Null pages have the empty payload. Pages may repeat: each row is a record of its own, and rows that
repeat the smallest id are all responses; a revisit gets the length of the response with its id and
digest, as other payloads may have the same id. Null page_ids are written as no id and read as null. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, store

SEGMENT, ARCHIVE, HTTP_CHUNK, AT_LEAST = 1 << 20, 32 << 20, 1 << 15, 0
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Sizes may carry extensions; trailers after the last chunk are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of an HTTP body is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def clean_uri(url: str | None) -> str | None:
    return "".join(c for c in url if c.isprintable()) if url else None


def records(page: int | None, url: str | None, payload: bytes, first: int | None, number: str, segment: int = SEGMENT) -> Iterator[bytes]:
    own, digest = f"<urn:page:{'' if page is None else page}:{number}>", "sha1:" + digest_of(payload)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", clean_uri(url)), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if page != first:
        about = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
        yield record(about + common, HEAD)
        return
    block = HEAD + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1 if len(parts) > 1 else None), *common], parts[0])
    for i, part in enumerate(parts[1:], 2):
        about = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i)]
        yield record([*about, ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None), *common[:2]], part)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, archive: int = ARCHIVE, at_least: int = AT_LEAST) -> DataFrame:
    """Write archives of (page_id, url, html) to ``folder``; returns their paths, staged."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("h", F.sha2("payload", 256))
    firsts = shared.stage(rows.select("page_id", "h").groupBy("h").agg(F.min("page_id").alias("first")), "warc-firsts").withColumnRenamed("h", "__h")
    rows = rows.join(firsts, F.col("h") == F.col("__h")).select("page_id", "url", "payload", F.when(F.length("payload") >= at_least, F.col("first")).otherwise(F.col("page_id")).alias("first"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, parts, size, made = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> None:
            made.append(f"{task:06d}-{TaskContext.get().taskAttemptId()}-{len(made):06d}.warc.gz")
            store.write(folder, made[-1], b"".join(parts))
            parts.clear()

        for b in it:
            for page, url, payload, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                n += 1
                for r in records(page, url, payload, first, f"{task}-{n}", segment):
                    parts.append(r)
                    size += len(r)
                    if size >= archive:
                        flush()
                        size = 0
        if parts:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["name"])

    return shared.stage(rows.mapInArrow(run, "name string"), "warc-names")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive is cut short")


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("record is cut short")
    return headers, rest[:size]


def page_of(urn: str | None) -> int | None:
    page = urn.strip("<>").split(":")[2] if urn else ""
    return int(page) if page else None


PARTS = "page_id bigint, kind string, refers_to bigint, digest string, n bigint, origin string, segment int, total bigint, block binary"


def checked(payload: bytes, stated: str | None) -> tuple[str, int]:
    digest = digest_of(payload)
    if stated and stated.removeprefix("sha1:") != digest:
        raise ValueError("payload digest differs from the header's")
    return digest, len(payload)


def read(names: DataFrame, folder: str) -> DataFrame:
    """(page_id, kind, refers_to, digest, n) of all records of the archives named."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in PARTS.split(", ")])
        for b in it:
            for name in b.column(0).to_pylist():
                system, path = store.opened(folder)
                with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                    rows = []
                    for member in members(f):
                        rows.append(_part(*parsed(member)))
                        if len(rows) >= 512:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    many = names.repartition(max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = shared.stage(many.mapInArrow(run, PARTS), "warc-parts")
    split = parts.filter("segment IS NOT NULL").groupBy("origin").applyInArrow(reassembled, "page_id bigint, kind string, refers_to bigint, digest string, n bigint")
    return parts.filter("segment IS NULL").select("page_id", "kind", "refers_to", "digest", "n").unionAll(split)


def _part(headers: dict[str, str], block: bytes) -> dict:
    own, kind, number = headers["warc-record-id"], headers["warc-type"], headers.get("warc-segment-number")
    stated = headers.get("warc-payload-digest")
    if number:
        total = headers.get("warc-segment-total-length")
        return {"page_id": page_of(own), "kind": kind, "digest": stated, "origin": headers.get("warc-segment-origin-id", own), "segment": int(number), "total": int(total) if total else None, "block": block}
    if kind == "revisit":
        return {"page_id": page_of(own), "kind": kind, "refers_to": page_of(headers["warc-refers-to"]), "digest": stated.removeprefix("sha1:")}
    digest, n = checked(payload_of(block), stated)
    return {"page_id": page_of(own), "kind": kind, "digest": digest, "n": n}


def reassembled(table: pa.Table) -> pa.Table:
    """One record from its segments."""
    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    block, total = b"".join(r["block"] for r in rows), rows[-1]["total"]
    if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or total != len(block):
        raise ValueError(f"{rows[0]['origin']}: segments {[r['segment'] for r in rows]} of {len(block)} bytes; {total} are stated")
    digest, n = checked(payload_of(block), rows[0]["digest"])
    return pa.table({"page_id": pa.array([rows[0]["page_id"]], pa.int64()), "kind": ["response"], "refers_to": pa.array([None], pa.int64()), "digest": [digest], "n": pa.array([n], pa.int64())})


def round_trip(pages: DataFrame, **how) -> DataFrame:
    folder = shared.fresh_path(pages.sparkSession, "warc")
    found = shared.stage(read(write(pages, folder, **how), folder), "warc-read")
    sizes = found.filter("kind = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("digest").alias("__digest")).agg(F.max("n").alias("__n"))
    again = found.filter("kind = 'revisit'").drop("n").join(shared.stage(sizes, "warc-sizes"), (F.col("refers_to") == F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    out = found.filter("kind <> 'revisit'").unionByName(again.withColumnRenamed("__n", "n").drop("__page", "__digest"))
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op5(pages: DataFrame) -> DataFrame:
    return round_trip(pages)
