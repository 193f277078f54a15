"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Every capture has three records. The response (or, for a payload that an earlier page has, the revisit) stands for
the capture; request and metadata name it as WARC-Concurrent-To. Reading parses the records of all archives and
joins them through these identifiers into one nested row for each capture.

Record identifiers are version-8 UUIDs that hold the page_id, so that what a revisit refers to is known without
looking it up, and the row's place in its task, so that repeated page_ids keep records of their own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corvane.llm.common import file_system, shared_dir, utf8, written

#: A digest is dealt with apart if its rows are more than one in this many; there can't be more such digests than that.
HOT = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def record_id(kind: int, page_id: int | None, task: int, row: int) -> str:
    """A URN of a version-8 UUID whose free 122 bits hold page_id (64), whether it is null (1), kind (2), task (20) and row (35)."""
    if task >> 20 or row >> 35:
        raise ValueError("too many tasks or rows")
    x = ((page_id or 0) & ((1 << 64) - 1)) << 58 | (page_id is None) << 57 | kind << 55 | task << 35 | row
    return "<urn:uuid:" + str(uuid.UUID(int=x >> 74 << 80 | 8 << 76 | (x >> 62 & 0xFFF) << 64 | 2 << 62 | x & ((1 << 62) - 1))) + ">"


def _task_row(place: int) -> tuple[int, int]:
    """Task and row of a value of monotonically_increasing_id()."""
    return place >> 33, place & (1 << 33) - 1


def page_of(record: str) -> int | None:
    """The page_id in a record identifier."""
    u = uuid.UUID(record[10:-1]).int
    x = u >> 80 << 74 | (u >> 64 & 0xFFF) << 62 | u & ((1 << 62) - 1)
    n = x >> 58
    return None if x >> 57 & 1 else n - (1 << 64) if n >> 63 else n


def _target(url: str | None) -> str:
    """The URL on one line: blanks and control characters percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), *headers, ("Content-Length", len(block))) if v != "")
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _capture(page_id: int | None, url: str | None, payload: bytes, place: int, least: int | None, first_place: int | None) -> list[bytes]:
    """The records of a page; least, first_place: the page whose response has the same payload, if that is another one, and its place."""
    own, asked, about = (record_id(k, page_id, *_task_row(place)) for k in range(3))
    target, digest = _target(url), "sha1:" + digest_of(payload)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if least is None:
        main = _record("response", [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")], http + payload)
    else:
        first = record_id(0, least, *_task_row(first_place))
        main = _record("revisit", [("WARC-Record-ID", own), *common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", first), ("WARC-Payload-Digest", digest), ("WARC-Truncated", "length"), ("Content-Type", "application/http;msgtype=response")], http)
    host, _, path = target.partition("://")[2].partition("/")
    request = _record("request", [("WARC-Record-ID", asked), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    metadata = _record("metadata", [("WARC-Record-ID", about), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"page-id: {'' if page_id is None else page_id}\r\n".encode())
    return [request, main, metadata]


def with_first(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, place, least, first_place): least is the smallest page_id with the same payload, where that is another page.

    Each row has a place of its own, written with it so that it holds for all later steps; first_place is that of the
    first row of `least` with the payload. Payloads meet by their digest. Few digests may have many rows: those above a
    thousandth of all rows, a thousand at most, are broadcast, so that no task gets more than that of one digest.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = written(p.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("place", F.monotonically_increasing_id()), folder, "placed")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place")))
    counted = p.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
    repeated = written(counted.where("n > 1").select("digest", F.col("first.page_id").alias("least"), F.col("first.place").alias("first_place"), "n"), folder, "repeated")
    total = p.count()
    hot, rest = (repeated.where(c).select(*(F.col(x).alias(f"{name}_{x}") for x in ("digest", "least", "first_place"))) for name, c in (("hot", F.col("n") * HOT > total), ("rest", F.col("n") * HOT <= total)))
    p = p.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNotNull(), F.concat_ws(":", "digest", "place")).otherwise(F.col("digest"))
    p = p.withColumn("key", key).join(rest, F.col("key") == F.col("rest_digest"), "left")
    least = F.coalesce("hot_least", "rest_least")
    other = least.isNotNull() & ~F.col("page_id").eqNullSafe(least)
    return p.select("page_id", "url", "html", "place", F.when(other, least).alias("least"), F.when(other, F.coalesce("hot_first_place", "rest_first_place")).alias("first_place"))


_MANIFEST = "task int, path string, records bigint"


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> list:
    """Writes pages (page_id, url, html, ...) as archives, one for each task, each record a gzip member; the driver gets a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        task = TaskContext.get().partitionId()
        fs, path = file_system(f"{folder}/part-{task:06d}.warc.gz")
        part, stream, row = f"{path}.{uuid.uuid4().hex}", None, 0
        for b in batches:
            for page, url, payload, *places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                stream = stream or fs.open_output_stream(part)
                for record in _capture(page, url, payload, *places):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    stream.write(z.compress(record) + z.flush())
                row += 1
        if stream:
            stream.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([f"{folder}/part-{task:06d}.warc.gz"]), pa.array([3 * row], pa.int64())], ["task", "path", "records"])

    return sorted(with_first(pages, folder).mapInArrow(run, _MANIFEST).collect(), key=lambda r: r.task)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive without compression: headers by lower-case name, and the block."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    import gzip

    names = ["capture", "kind", "record", "target", "payload_bytes", "payload_digest", "refers_to", "body"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    out: list[tuple] = []
    held = 0
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, at = file_system(path)
            with fs.open_input_stream(at, compression=None) as raw, gzip.open(raw, "rb") as stream:
                for h, block in parse(stream):
                    kind = h["warc-type"]
                    n = digest = None
                    body = block
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            n, found = len(body), digest_of(body)
                            if digest != found:
                                raise ValueError(f"the payload of {h['warc-record-id']} is damaged")
                        else:
                            n = int(dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"content-length"])
                    out.append((h.get("warc-concurrent-to", h["warc-record-id"]), kind, h["warc-record-id"], h.get("warc-target-uri"), n, digest, h.get("warc-refers-to"), body if payloads else None))
                    held += len(block) * payloads + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read_captures(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    """One nested row for each capture: (capture, request, response, metadata), each record a struct or null.

    Records of all archives meet through the identifier that they name as concurrent, so a capture's records may lie in
    several archives and in any order. `payloads` false leaves out the bodies, which then are not shuffled.
    """
    schema = "capture string, kind string, record string, target string, payload_bytes bigint, payload_digest string, refers_to string, body binary"
    if not paths:
        records = spark.createDataFrame([], schema)
    else:
        records = spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(lambda b: _records(b, payloads), schema)
    body = ["body"] if payloads else []

    def of(kinds: list[str], *fields: str):
        return F.first(F.when(F.col("kind").isin(kinds), F.struct(*fields, *body)), ignorenulls=True)

    return records.groupBy("capture").agg(
        of(["request"], "record", "target").alias("request"),
        of(["response", "revisit"], "record", "kind", "target", "payload_bytes", "payload_digest", "refers_to").alias("response"),
        of(["metadata"], "record", "target").alias("metadata"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, n_records).

    One row for each row of pages (page_id, url, html, ...). A null html is an empty payload, and empty payloads are
    equal as others are. Of rows with equal payloads, those with the smallest page_id are responses (all of them, if it
    repeats, or if all are null), the others revisits of it; null page_ids come last. Payloads of any length are written
    and digested whole, one at a time; repeated rows are captures of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    manifest = write_archives(pages, folder)
    c = read_captures(spark, [m.path for m in manifest], payloads=False)
    # what a revisit refers to is found among the responses that were read; captures that refer to nothing meet themselves, so that they are no group
    c = written(c.select("capture", "request", "response", "metadata"), folder, "captures")
    asked = F.coalesce("response.refers_to", "capture").alias("asked")
    found = c.where("response.kind = 'response'").select(F.col("response.record").alias("record"), _page_column(F.col("response.record")).alias("first_page"))
    c = c.select("*", asked).join(found, F.col("asked") == F.col("record"), "left")
    return c.select(
        _page_column(F.col("capture")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), F.col("first_page")).alias("refers_to"),
        (F.lit(1) + F.col("request").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")).alias("n_records"),
    )


def _page_column(record):
    """page_of as a column expression: the bits of page_id are the first 12 hexadecimal digits, 3 after the version, and the lowest of the variant's digits."""
    d = F.translate(F.substring(record, 11, 36), "-", "")
    # 48 bits, 12 bits, then the 4 bits below the two of the variant
    high = F.conv(F.substring(d, 1, 12), 16, 10).cast("decimal(20,0)").cast("bigint")
    mid = F.conv(F.substring(d, 14, 3), 16, 10).cast("bigint")
    low = F.conv(F.substring(d, 17, 2), 16, 10).cast("bigint")
    null = F.conv(F.substring(d, 17, 2), 16, 10).cast("bigint").bitwiseAND(2) != 0
    value = F.shiftleft(high, 16).bitwiseOR(F.shiftleft(mid, 4)).bitwiseOR(F.shiftright(low, 2).bitwiseAND(15))
    return F.when(record.isNotNull() & ~null, value)
