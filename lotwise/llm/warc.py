"""WARC archives: writing with revisits, segments and chunked framing, and reading back.

Writing. A page's HTML becomes a response record: an HTTP header and the body in chunked transfer
framing. A block above SEGMENT_BYTES is cut: the first part is segment 1 of the response, the rest
are continuation records that name it as their origin, the last one with the total length. Of pages
with equal bodies of at least REVISIT_BYTES the one with the largest page_id is written in full and
the others as revisit records that refer to it. Spark's text writer joins the records with the blank
lines that end a WARC record, compresses them, and starts a new file every RECORDS_PER_FILE records.

Reading. Every file is parsed record by record. Unsegmented records are whole as they are; the others
are grouped by origin identifier, ordered by segment number, joined, and their length is checked
against the total. Then the chunk framing is taken off. ``status`` says what is wrong with a record
(missing segment, conflicting segments, wrong length, bad framing) or ``complete``; nothing is left
out silently. An archive is one row of Spark's binary reader, so it must fit a task: those written here are
bounded, foreign ones of gigabytes have to be cut before. Files are compressed as a whole.

Results for odd rows: a null html is an empty body; a null page_id is kept as null and never the one
that others refer to; rows repeated as a whole come back repeated; equal bodies under one page_id
are all responses; an empty table gives an archive without records and an empty result; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, new_path, stored

REVISIT_BYTES = 1000
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4096
#: Bounds a file at RECORDS_PER_FILE * (SEGMENT_BYTES + headers).
RECORDS_PER_FILE = 2000
#: Up to this many groups of equal pages are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 500_000
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, origin_id string, type string, page_id long, uri string, refers_to string, digest string, segment int, total long, block binary"
PAGES = "record_id string, page_id long, uri string, record_type string, refers_id string, refers_to long, payload binary, payload_bytes long, payload_digest string, status string"


def record_id(page_id, digest: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}:{segment}'.encode()).hexdigest())}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for k in range(0, len(body), size) if (part := body[k : k + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes | None:
    """The body inside chunked framing (extensions and trailers are skipped), None if it is broken."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        head = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not head or head.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(head, 16), end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != CRLF:
            return None
        out.append(data[at : at + size])
        at += size + 2


def one_line(text: str | None) -> str:
    return "" if text is None else " ".join(text.split())


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block


def page_records(page_id, url, body: bytes, digest: str, refers_page, segment_bytes: int = SEGMENT_BYTES):
    """The WARC records of a page, without the blank lines after each."""
    me = record_id(page_id, digest)
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    named = [("WARC-Target-URI", one_line(url) or None), ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_page is not None:
        block = f"{http}Content-Length: {len(body)}\r\n\r\n".encode()
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_page, digest))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, *named, *refers], block)
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(body)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, *named], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *common, *named, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for k in range(segment_bytes, len(block), segment_bytes):
        number = k // segment_bytes + 1
        total = len(block) if k + segment_bytes >= len(block) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, number)), ("WARC-Date", "1970-01-01T00:00:00Z")]
        yield _record([*fields, ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], block[k : k + segment_bytes])


def _write(batches):
    import pyarrow as pa

    for batch in batches:
        out, size = [], 0
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "refers_page")]
            for record in page_records(*row):
                out.append(record)
                size += len(record)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) to archives under ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    base = base.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    groups = base.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    groups = broadcast_if_small(stored(groups.where(F.col("copies") > 1).select("digest", "bytes", "top"), "equal_pages"), BROADCAST_GROUPS)
    rows = base.join(groups, ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_page"))
    records = rows.mapInArrow(_write, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_archive(stream):
    """(fields with lower-case names, block) of every record of an uncompressed archive."""
    while True:
        line = stream.readline()
        while line == CRLF:
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        yield fields, block


def _read(batches):
    import gzip

    import pyarrow as pa

    number = lambda x: None if x is None else int(x)
    schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            raw = content.as_buffer()
            stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw)) if raw[:2].to_pybytes() == b"\x1f\x8b" else pa.BufferReader(raw))
            for f, block in parse_archive(stream):
                segment = number(f.get("warc-segment-number"))
                origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
                digest = (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                rows.append((f.get("warc-record-id"), origin, f.get("warc-type"), number(f.get("page-id")), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, segment, number(f.get("warc-segment-total-length")), block))
                size += len(block)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, as they are stored."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, RECORDS)


def joined(segments: list[tuple[int, int | None, bytes]]) -> tuple[list[bytes], str]:
    """(blocks, status) of the (number, total length, bytes) segments of one record; several blocks
    if the whole record is there several times."""
    by_number: dict[int, list[bytes]] = {}
    for number, _, part in segments:
        by_number.setdefault(number, []).append(part)
    totals = {total for _, total, _ in segments if total is not None}
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or not totals:
        return [b""], "missing segment"
    copies = {len(parts) for parts in by_number.values()}
    if len(totals) > 1 or len(copies) > 1 or any(len(set(parts)) > 1 for parts in by_number.values()):
        return [b""], "conflicting segments"
    block = b"".join(by_number[k][0] for k in sorted(by_number))
    if len(block) != totals.pop():
        return [b""], "wrong length"
    return [block] * copies.pop(), "complete"


def payload_of(kind: str, block: bytes) -> tuple[bytes, int, str]:
    """(payload, its full length, status) of an HTTP response; a revisit has its length only."""
    head, gap, body = block.partition(CRLF * 2)
    if not gap:
        return b"", 0, "bad framing"
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if kind == "revisit":
        return b"", int(fields.get(b"content-length", b"0")), "complete"
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunked(body)
        if body is None:
            return b"", 0, "bad framing"
    return body, len(body), "complete"


def _pages(batches):
    import pyarrow as pa

    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())])
    for batch in batches:
        out, size = [], 0
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            parts = row["segments"].as_py()
            blocks, status = ([parts[0]["block"]], "complete") if parts[0]["segment"] is None else joined([(p["segment"], p["total"], p["block"]) for p in parts])
            kind = row["type"].as_py()
            for block in blocks:
                body, length, framing = payload_of(kind, block) if status == "complete" else (b"", 0, status)
                digest = row["digest"].as_py() if kind == "revisit" else hashlib.sha1(body).hexdigest()
                if framing == "complete" and digest != row["digest"].as_py():
                    framing = "wrong digest"
                out.append((row["record_id"].as_py(), row["page_id"].as_py(), row["uri"].as_py(), kind, row["refers_to"].as_py(), row["refers_page"].as_py(), body, length, digest, framing))
                size += len(body)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, page_id, uri, record_type, refers_id, refers_to, payload,
    payload_bytes, payload_digest, status. Only segments are shuffled, and the headers of revisits and
    of responses: a revisit gets the page_id of the response that it refers to before payloads are
    put together."""
    kind = F.col("type")
    named = records.where((kind == "response") & F.col("digest").isNotNull()).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page")).distinct()
    revisits = records.where(kind == "revisit").join(named, "refers_to", "left")
    records = records.where(~kind.eqNullSafe("revisit")).withColumn("refers_page", F.lit(None).cast("long")).unionByName(revisits)
    part = F.struct("segment", "total", "block")
    about = ["record_id", "type", "page_id", "uri", "refers_to", "refers_page", "digest"]
    whole = records.where(F.col("segment").isNull() & kind.isin("response", "revisit")).select(*about, F.array(part).alias("segments"))
    cut = records.where(F.col("segment").isNotNull()).groupBy("origin_id").agg(F.sort_array(F.collect_list(part)).alias("segments"), *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in about if c != "record_id"))
    cut = cut.select(F.col("origin_id").alias("record_id"), *about[1:], "segments")
    return whole.unionByName(cut).mapInArrow(_pages, PAGES)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``reassemble`` over the archives under ``path``."""
    return reassemble(stored(read_records(spark, path), "records"))  # parsed once, read for each kind


def through_archives(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_pages(spark, path)


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to, 'complete' AS status FROM g
"""
