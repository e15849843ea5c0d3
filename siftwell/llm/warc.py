"""WARC archives with segmented records: writing, reading, reassembly.

``write_archive`` lays each page out as an HTTP response in chunked transfer
framing. A block longer than ``segment_bytes`` becomes a first record with
``WARC-Segment-Number: 1`` and continuation records that name it as
``WARC-Segment-Origin-ID``; the last gives ``WARC-Segment-Total-Length``.
Equal payloads of at least ``revisit_bytes`` are stored once, under the largest
page id; the others become revisit records. Files come from Spark's own text
writer, whose line end is the two CRLF that close a WARC record, so they go
wherever Spark can write, survive task retries and hold at most
``records_per_file`` records of at most a segment each.

``read_archive`` parses each file once, into a written table, groups segments by
origin, orders them by number, verifies the total length, decodes the chunked
framing and resolves revisits. Segments that follow one another in a file are
joined where they are read; what is torn between files is dealt by origin and
put together as it streams by, one record at a time. Records that are whole skip
the grouping.

Defined results: a null html is an empty payload, a null url an empty target
URI; rows that repeat the largest page id of a payload are all responses; a
null page id is smaller than any other and comes back null; a record with a
missing segment, a wrong total, broken framing or a wrong length comes back with
``ok`` false and a null payload, and without a type if its header or first
segment is lost; files that are cut short or damaged give what is whole in them;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_path, spread, spread_join, table, tidy, written

SEGMENT_BYTES = 65_536
#: Bytes of neighbouring segments that reading joins at once.
RUN_BYTES = 8_000_000
#: Segments of op5's archives: short, so that many pages are reassembled.
OP5_SEGMENT_BYTES = 4096
CHUNK_BYTES = 16_384
REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
CRLF = "\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = "record_id string, record_type string, page_id bigint, url string, refers_to bigint, payload_digest string, origin_id string, segment int, last int, total_length bigint, block binary"
PAGE = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload binary, ok boolean"


def _cut(data: bytes, size: int):
    """Pieces of at most ``size`` bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload_of(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, ident: str, block: bytes, *more: tuple[str, object]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), *more, ("Content-Length", len(block))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + CRLF + block.decode("utf-8")


def _line(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in "\r\n")


def page_records(page_id, url, html, digest, refers_to, serial, segment_bytes):
    """The records of one page, in order."""
    ident = f"urn:x-page:{'' if page_id is None else page_id}:{serial}"
    own = [("WARC-Target-URI", _line(url)), ("X-Page-Id", "" if page_id is None else page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        yield _record("revisit", ident, b"", *own, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", refers_to))
        return
    block = HTTP_HEAD + chunked((html or "").encode("utf-8"))
    if len(block) <= segment_bytes:
        yield _record("response", ident, block, *own)
        return
    parts = list(_cut(block, segment_bytes))
    yield _record("response", ident, parts[0], *own, ("WARC-Segment-Number", 1))
    for n, part in enumerate(parts[1:], 2):
        last = (("WARC-Segment-Total-Length", len(block)),) if n == len(parts) else ()
        yield _record("continuation", f"{ident}:{n}", part, ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", n), *last)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """``pages`` has page_id, url, html."""
    from pyspark import TaskContext

    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    long = src.filter(F.octet_length("html") >= revisit_bytes)
    top = long.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").select("digest", "top")
    # a third of all pages may be copies of one
    top = written(top, "warc-copies")
    src = spread_join(src, top, "digest", "page_id", "left").select("page_id", "url", "html", "digest", F.expr("if(page_id <=> top, null, top)").alias("refers_to"))

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                serial += 1
                for record in page_records(page_id, url, html, digest, refers_to, serial, segment_bytes):
                    out.append(record)
                    size += len(record)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    src.mapInArrow(tidy(run), "value string").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def unpacked(data: bytes) -> bytes:
    """What a file holds, as far as it can be unpacked."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes):
    """(header names in lower case -> values, block) of each record. The block
    is None if the record is not whole: cut short, without a length, or of
    another length than it says; without an end of its header, the header is
    empty. Reading goes on with the next record that begins."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head: dict[str, str] = {}
        if end >= 0 and data.startswith(b"WARC/", at):
            lines = data[at:end].decode("utf-8", "replace").split(CRLF)
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        begin = end + 4
        stop = begin + int(length) if length.isdecimal() and len(length) < 16 else -1
        if begin <= stop <= len(data) and b"\r\n\r\n".startswith(data[stop : stop + 4]):
            yield head, data[begin:stop]
            at = stop + 4
        else:
            yield head, None
            after = data.find(b"\r\n\r\nWARC/", max(at, end if head else at))
            at = after + 4 if after >= 0 else len(data)


def records_of(data: bytes, run_bytes: int = RUN_BYTES):
    """Rows of RECORD of one file's content; a record that is not whole has no
    block, and none of it but that is known if its header does not name it."""
    run, blocks = None, []

    def number(x):
        return int(x) if x and x.lstrip("-").isdecimal() and len(x) < 19 else None

    def done():
        nonlocal run, blocks
        if run:
            yield (*run, None if None in blocks else b"".join(blocks))
        run, blocks = None, []

    for head, block in parse(unpacked(data)):
        ident, kind = head.get("warc-record-id", "").strip("<>"), head.get("warc-type")
        if not ident or not kind:
            yield from done()
            yield (*[None] * 10, None)
            continue
        origin, n, total = head.get("warc-segment-origin-id", ident).strip("<>"), number(head.get("warc-segment-number")), number(head.get("warc-segment-total-length"))
        if run and origin == run[6] and n == run[8] + 1 and run[9] is None and sum(len(x or b"") for x in blocks) < run_bytes:
            run[8], run[9] = n, total
            blocks.append(block)
            continue
        yield from done()
        run = [ident, kind, number(head.get("x-page-id")), head.get("warc-target-uri"), number(head.get("x-refers-to-page-id")), head.get("warc-payload-digest", "").removeprefix("sha1:"), origin, n, n, total]
        blocks = [block]
        if n is None:
            yield from done()
    yield from done()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives; those that are whole have no segment, the others
    come as runs of segments of one origin, ``segment`` to ``last``."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    most = RUN_BYTES

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    def run(batches):
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for row in records_of(data.as_py(), most):
                    out.append(row)
                    size += len(row[-1] or b"")
                    if size > 8_000_000:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(tidy(run), RECORD)


def reassemble(runs: DataFrame) -> DataFrame:
    """Whole blocks of segmented records: origin_id, block; the block is null
    unless numbers run from 1 without a gap or repeat and the total is right."""

    def whole(origin, parts):
        blocks, total, good, upto = [], None, True, 0
        for _, segment, last, length, block in parts:
            good, upto = good and segment == upto + 1 and block is not None, last
            total = length if length is not None else total
            if good:  # what is broken is not held
                blocks.append(block)
        held = b"".join(blocks) if good else None
        found = held if held is not None and len(held) == total else None
        return pa.RecordBatch.from_arrays([pa.array([origin], pa.string()), pa.array([found], pa.binary())], names=["origin_id", "block"])

    def run(batches):
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        for origin, parts in groupby(rows, key=lambda r: r[0]):
            yield whole(origin, parts)

    dealt = runs.select("origin_id", "segment", "last", "total_length", "block").repartition("origin_id").sortWithinPartitions("origin_id", "segment")
    return dealt.mapInArrow(tidy(run), "origin_id string, block binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record, payloads decoded and revisits resolved."""
    records = written(read_records(spark, path), "warc-records")
    cols = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_digest"]
    alone, runs = records.filter("segment is null"), records.filter("segment is not null")
    headed = F.max(F.col("record_type") != "continuation").alias("headed")
    torn = written(runs.groupBy("origin_id").agg(F.count("*").alias("n"), headed).filter("n > 1 or not headed").select("origin_id", F.col("headed").alias("torn")), "warc-torn")
    runs = spread_join(runs, torn, "origin_id", "segment", "left")
    near = runs.filter("torn is null and record_type <> 'continuation'")
    near = near.select(*cols, F.when((F.col("segment") == 1) & (F.octet_length("block") == F.col("total_length")), F.col("block")).alias("block"))
    far = runs.filter("torn")
    first = far.filter("record_type <> 'continuation'").select(*cols)
    far = first.join(reassemble(far), first.record_id == F.col("origin_id")).select(*cols, "block")
    # segments whose first record is lost
    lost = torn.filter("not torn").select(F.col("origin_id").alias("record_id"), *[F.lit(None).cast(alone.schema[c].dataType).alias(c) for c in (*cols[1:], "block")])
    both = alone.select(*cols, "block").unionByName(near).unionByName(far).unionByName(lost)

    def run(batches):
        for b in batches:
            kinds, digests, blocks = (b.column(i).to_pylist() for i in (3, 5, 6))
            found = [None if k == "revisit" or x is None else payload_of(x) for k, x in zip(kinds, blocks, strict=True)]
            ok = [k == "revisit" or (x is not None and hashlib.sha1(x).hexdigest() == d) for k, x, d in zip(kinds, found, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([x if y else None for x, y in zip(found, ok, strict=True)], pa.binary()), pa.array(ok, pa.bool_())], names=[x.split()[0] for x in PAGE.split(", ")])

    return both.mapInArrow(tidy(run), PAGE)


def digest_rows(read: DataFrame) -> DataFrame:
    """Digests of each page's full payload; a revisit takes the one it names."""
    rows = read.select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("d"), F.col("payload_digest").alias("named"))
    rows = written(rows, "warc-rows")
    revisits = rows.filter("record_type = 'revisit'").drop("n", "d").withColumn("key", F.concat_ws(":", F.col("refers_to").cast("string"), "named"))
    first = rows.filter("record_type = 'response' and page_id is not null").groupBy(F.concat_ws(":", F.col("page_id").cast("string"), "d").alias("key")).agg(F.max("n").alias("n2"))
    # many revisits may name one response
    first = written(first.join(revisits.select("key").distinct(), "key", "left_semi"), "warc-named")
    again = spread_join(revisits, first, "key", "page_id", "left")
    return rows.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to").unionByName(
        again.select("page_id", F.col("n2").alias("payload_bytes"), F.when(F.col("n2").isNotNull(), F.col("named")).alias("payload_digest"), "record_type", "refers_to")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path, OP5_SEGMENT_BYTES)
    return digest_rows(read_archive(spark, path))


SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m"""
}
