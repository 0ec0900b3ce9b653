"""WARC records as a chunked record table.

A record is rows (record_id, chunk_no, data, running): data of a record's rows in
chunk order is one WARC/1.1 record, running the SHA-256 of its payload up to and
with that row. Chunk 0 holds the headers, the following ones at most CHUNK bytes
of payload, the last the closing blank lines. Writer and reader hold one chunk
and a hash state at a time; nothing is joined to a whole record.

Of pages with equal payloads of MIN_REVISIT bytes and more, the one with the
smallest id is a response with the payload; the others are revisits that carry
its digest and a reference to it, resolved when the archive is read.

Cases: null html is an empty payload; null ids are last among equals, and if all
are null all are responses; rows that repeat an id and its payload are a record
each, of one type; an empty table gives an empty archive and an empty result;
null urls leave out the target header.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, staged

CHUNK = 64 << 10
MIN_REVISIT = 100
RECORDS = "record_id string, chunk_no int, data binary, running string"
_RECORDS = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("running", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_heads(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(page_id, head): pages whose payload an earlier page has, by digest and length. Counts are combined before the shuffle."""
    body = F.coalesce(html_col, F.lit("")).cast("binary")
    narrow = staged(pages.select(F.col(id_col).alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= MIN_REVISIT), "payloads")
    heads = narrow.groupBy("digest", "n").agg(F.min("page_id").alias("head"), F.count("*").alias("rows")).filter("rows > 1 and head is not null")
    return staged(narrow.join(heads, ["digest", "n"]).filter("page_id is null or page_id <> head").groupBy("page_id", "digest").agg(F.min("head").alias("head")), "revisits")


def _clean(value) -> str:
    return "".join(x for x in str(value) if x not in "\r\n")


def _headers(key: str, url, size: int, digest: str, head) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if head is not None:
        lines += [f"WARC-Refers-To: <urn:page:{head}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(http) + (size if head is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches):
    """Rows (page_id, url, body, head) to chunk rows; slices of the column's buffer are hashed and passed on in place."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    rows, held = [], 0
    for batch in batches:
        ids, urls, bodies, heads = (batch.column(k) for k in ("page_id", "url", "body", "head"))
        for i in range(batch.num_rows):
            page, url, head = ids[i].as_py(), urls[i].as_py(), heads[i].as_py()
            view = memoryview(bodies[i].as_buffer() if bodies[i].is_valid else b"")
            whole = hashlib.sha256()
            for at in range(0, len(view), CHUNK):
                whole.update(view[at : at + CHUNK])
            key, seq = f"{'' if page is None else page}/{part}.{seq}", seq + 1
            running = hashlib.sha256()
            rows.append((key, 0, _headers(key, url, len(view), whole.hexdigest(), head), running.hexdigest()))
            no = 1
            for at in range(0, len(view) if head is None else 0, CHUNK):
                piece = view[at : at + CHUNK]
                running.update(piece)
                rows.append((key, no, bytes(piece), running.hexdigest()))
                no, held = no + 1, held + len(piece)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            rows.append((key, no, b"\r\n\r\n", running.hexdigest()))
            if len(rows) > 20_000:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The written chunk table of all pages."""
    body = F.coalesce(html_col, F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    heads = payload_heads(pages, id_col, html_col)
    same = F.col("r.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("r.digest") == F.col("h.digest"))
    joined = join_checked(rows.alias("r"), heads.alias("h"), same, "left", 100)
    return staged(joined.select("r.page_id", "r.url", "r.body", "h.head").mapInArrow(_write, RECORDS), "archive")


class _Reader:
    """State of the record being read: header lines, bytes still to come, hash so far."""

    def __init__(self, key: str):
        self.key, self.head, self.fields, self.left, self.size, self.sum, self.running = key, b"", None, 0, 0, hashlib.sha256(), ""

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            top, mark, rest = self.head.partition(b"\r\n\r\n")
            http, mark2, data = rest.partition(b"\r\n\r\n")
            if not (mark and mark2):
                return
            lines = top.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"record {self.key} doesn't begin a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
        data = data[: self.left]
        self.sum.update(data)
        self.left, self.size = self.left - len(data), self.size + len(data)

    def row(self) -> tuple:
        if self.fields is None or self.left or self.running != self.sum.hexdigest():
            raise ValueError(f"record {self.key} is cut off or damaged")
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1].split("/")[0]) else None
        stated, kind = self.fields["WARC-Payload-Digest"].removeprefix("sha256:"), self.fields["WARC-Type"]
        if kind == "response" and stated != self.sum.hexdigest():
            raise ValueError(f"record {self.key} has another digest than its header states")
        refers = number(self.fields["WARC-Refers-To"]) if kind == "revisit" else None
        return number(self.fields["WARC-Record-ID"]), self.size if kind == "response" else None, stated, kind, refers


def _read(batches):
    reader, rows = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    for batch in batches:
        keys, data, running = batch.column("record_id").to_pylist(), batch.column("data"), batch.column("running").to_pylist()
        for i, key in enumerate(keys):
            if reader is None or reader.key != key:
                if reader:
                    rows.append(reader.row())
                reader = _Reader(key)
            reader.feed(data[i].as_py())
            reader.running = running[i]
        if len(rows) > 5000:
            yield out()
            rows = []
    if reader:
        rows.append(reader.row())
    if rows:
        yield out()


def read_archive(records: DataFrame) -> DataFrame:
    """One row per record; every payload is hashed again, and revisits take their size from the record that they refer to."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.repartition(parts, "record_id").sortWithinPartitions("record_id", "chunk_no")
    found = staged(ordered.mapInArrow(_read, READ), "records")
    sizes = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"))
    revisits = found.filter("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    revisits = revisits.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return found.filter("record_type = 'response'").unionByName(revisits)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM m
"""
