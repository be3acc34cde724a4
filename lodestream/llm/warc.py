"""WARC archives: writing with revisit records, and reading with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .kernels import by_bytes

#: Longest block of a record, longer ones are split into segments; longest chunk of a body; bytes of an archive, about.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 1 << 16, 1 << 14, 32 << 20
END = "\r\n"

PARSED = "record_type string, record_id string, refers_to_id string, page_id long, url string, payload_bytes long, payload_digest string, complete boolean, payload binary, origin_id string, segment int, total_length long, block binary"
PARSED_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_()), ("payload", pa.binary()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column: each 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _cut(data: bytes, most: int) -> list[bytes]:
    """Pieces of up to ``most`` bytes that don't split a code point, so that archives stay valid UTF-8."""
    out, at = [], 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def _urn(seed: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(seed.encode()).digest())}>"


def _record(kind: str, own: str, block: bytes, **headers) -> str:
    named = {"WARC-Type": kind, "WARC-Record-ID": own} | {k.replace("_", "-"): v for k, v in headers.items() if v is not None} | {"Content-Length": len(block)}
    return "".join(["WARC/1.1", END, *(f"{k}: {v}{END}" for k, v in named.items()), END]) + block.decode()


def _records(page_id: int | None, url: str | None, html: str | None, digest: str, response: int | None, revisit: bool, segment: int, chunk: int) -> Iterator[str]:
    body = (html or "").encode()
    own = _urn(f"{page_id}|{digest}")
    target = None if url is None else " ".join(url.split())
    shared = {"WARC_Date": "2000-01-01T00:00:00Z", "WARC_Target_URI": target, "X_Page_Id": page_id, "WARC_Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http;msgtype=response"}
    head = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    if revisit:
        block = f"{head}Content-Length: {len(body)}{END}{END}".encode()
        yield _record("revisit", own, block, **shared, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=_urn(f"{response}|{digest}"))
        return
    if len(body) > chunk:
        framed = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cut(body, chunk)) + b"0\r\n\r\n"
        block = f"{head}Transfer-Encoding: chunked{END}{END}".encode() + framed
    else:
        block = f"{head}Content-Length: {len(body)}{END}{END}".encode() + body
    parts = _cut(block, segment) if len(block) > segment else [block]
    yield _record("response", own, parts[0], **shared, WARC_Segment_Number=1 if len(parts) > 1 else None)
    for i, part in enumerate(parts[1:], 2):
        yield _record("continuation", _urn(f"{own}#{i}"), part, WARC_Date="2000-01-01T00:00:00Z", WARC_Segment_Number=i, WARC_Segment_Origin_ID=own, WARC_Segment_Total_Length=len(block) if i == len(parts) else None)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, archive: int = ARCHIVE_BYTES) -> None:
    """Write one record per page into gzipped WARC files under ``path``, a folder that all executors share.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least ``least``
    bytes that with the largest page_id is a response, and the others are revisit records that refer to it; all other
    pages are responses. Pages that repeat that id and payload are responses too, under one record id; a null page_id is never the
    largest. Bodies above ``chunk`` bytes have chunked framing, blocks above ``segment`` bytes are split into continuation records.

    The digests are pre-aggregated before their shuffle; pages join them in a sort-merge join, of which
    Spark splits a hot payload. Spark's text writer, whose line end is that of a record, commits the files.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    own = own.withColumn("digest", base32_sha1(F.col("html")))
    n, total = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    response = own.filter(F.octet_length("html") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.max("page_id").alias("response"))
    told = own.join(response.hint("merge"), own["digest"] == response["_digest"], "left").drop("_digest")
    told = told.withColumn("revisit", F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "html"):
            rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "response", "revisit")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([r for row in rows for r in _records(*row, segment, chunk)], pa.string())], ["value"])

    told = told.select("page_id", "url", "html", "digest", "response", "revisit")
    each = max(1, int(archive / ((total or 0) / max(n, 1) + 600)))
    told.mapInArrow(run, "value string").write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are passed over. ValueError if it is cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        if line + 2 + size > len(body):
            raise ValueError("chunk is cut short")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; None if it isn't whole."""
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    try:
        if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
            return dechunk(body)
        if gap and len(body) == int(fields.get(b"content-length", len(body))):
            return body
    except ValueError:
        pass
    return None


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzipped as a whole, record by record, or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _whole(headers: dict[str, str], block: bytes, keep: bool) -> dict:
    payload = payload_of(block)
    said = headers.get("warc-payload-digest", "").rpartition(":")[2]
    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"payload_bytes": None if payload is None else len(payload), "payload_digest": digest, "complete": payload is not None and said in ("", digest), "payload": payload if keep else None}


def _row(headers: dict[str, str], block: bytes, keep: bool) -> dict:
    kind, page = headers.get("warc-type"), headers.get("x-page-id")
    row = {"record_type": kind, "record_id": headers.get("warc-record-id"), "refers_to_id": headers.get("warc-refers-to"), "page_id": int(page) if page else None, "url": headers.get("warc-target-uri")}
    if number := headers.get("warc-segment-number"):
        total = headers.get("warc-segment-total-length")
        return row | {"origin_id": headers.get("warc-segment-origin-id", row["record_id"]), "segment": int(number), "total_length": int(total) if total else None, "block": block, "payload_digest": headers.get("warc-payload-digest")}
    if kind == "revisit":
        return row | {"payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2], "complete": True}
    return row | _whole(headers, block, keep)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + len(row.get("block") or b"") + len(row.get("payload") or b"")
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, PARSED_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, PARSED_ARROW)


def _reassembled(keep: bool):
    def run(table: pa.Table) -> pa.Table:
        """All segments of one origin. Repeats of a number are copies of the whole record, which is returned as often as its first segment occurs."""
        rows = sorted(table.to_pylist(), key=lambda r: (r["segment"], r["record_type"] == "continuation"))
        parts = {r["segment"]: r["block"] for r in rows}
        block = b"".join(parts[i] for i in sorted(parts))
        total = next((r["total_length"] for r in rows if r["total_length"] is not None), None)
        heads = [r for r in rows if r["segment"] == 1]
        out = []
        for head in heads or rows[:1]:
            whole = _whole({"warc-payload-digest": head["payload_digest"] or ""}, block, keep)
            if not heads or sorted(parts) != list(range(1, len(parts) + 1)) or total != len(block):
                whole = {"payload_bytes": None, "payload_digest": None, "complete": False, "payload": None}
            out.append(head | whole | {"block": None, "segment": None, "origin_id": None, "total_length": None})
        return pa.Table.from_pylist(out, PARSED_ARROW)

    return run


def read_archives(spark: SparkSession, path: str, *, glob: str = "*.gz", keep_payload: bool = True) -> DataFrame:
    """One row per response or revisit record: record_type, record_id, refers_to_id, page_id, url,
    payload_bytes, payload_digest, complete, payload (null unless ``keep_payload``), refers_to, the page_id of a revisit's response.

    Segments are grouped by their origin's id, ordered by number, checked against the total length and joined; then the HTTP framing
    is decoded. A record that lacks a segment, has another length or digest than it says, or a body cut short has complete = false and no
    payload. A group holds one record's segments, nothing more. Revisits take bytes and payload of their
    response (Spark may split a hot one). An archive must fit into a task (see ARCHIVE_BYTES); an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(_row(h, b, keep_payload) for h, b in _parse(content.as_py()))

    parsed = materialise(files.mapInArrow(run, PARSED), "warc-records")
    segments = parsed.filter("segment is not null").groupBy("origin_id").applyInArrow(_reassembled(keep_payload), PARSED)
    known = ["record_type", "record_id", "refers_to_id", "page_id", "url", "payload_bytes", "payload_digest", "complete", "payload"]
    whole = parsed.filter("segment is null").select(known).unionByName(segments.select(known))
    responses = whole.filter("record_type = 'response'")
    origin = responses.groupBy(F.col("record_id").alias("_id")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"), *([F.max("payload").alias("_payload")] if keep_payload else []))
    again = whole.filter("record_type = 'revisit'").join(origin.hint("merge"), F.col("refers_to_id") == F.col("_id"), "left")
    ok = F.col("_id").isNotNull() & F.col("payload_digest").eqNullSafe(F.col("_digest"))
    again = again.select(*[{"payload_bytes": F.col("_bytes").alias("payload_bytes"), "complete": ok.alias("complete"), "payload": (F.col("_payload") if keep_payload else F.col("payload")).alias("payload")}.get(c, F.col(c)) for c in known], "refers_to")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
