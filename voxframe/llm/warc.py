"""WARC archives: writing with revisits, segments and chunked framing, and reassembly.

Writing: pages with equal payloads keep one full ``response`` (that of the smallest page_id), the others
become ``revisit`` records that name it. A block longer than ``segment_bytes`` is cut: the first record has
segment number 1, the others are ``continuation`` records that carry the first one's id, and the last one states the
total length. Payloads over ``chunk_bytes`` are framed with chunked transfer coding. Each record is a
gzip member of its own.

Reading: archives are parsed record by record; continuation records are grouped by origin id wherever they lie,
ordered by segment number, and checked for gaps and against the total length; then HTTP heads are split
off and the chunked framing is undone. Faults become the text in ``error``, never a failed job.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import job_folder, put_file, written

#: Fixed values of the format (WARC/1.1).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

#: Fields whose value is a whole number; a page id may be negative.
NUMBERS = ("warc-segment-number", "warc-segment-total-length")

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
ARCHIVE_BYTES = 32 << 20


# --- bytes ------------------------------------------------------------------------------------

def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int) -> bytes:
    """Chunked transfer coding with chunks of ``size`` bytes."""
    parts = []
    for i in range(0, len(data), size):
        piece = data[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunk(data: bytes) -> bytes:
    """Undo chunked framing (extensions and trailers are skipped); ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        try:
            size = int(data[at:end].split(b";", 1)[0].strip(), 16)
        except ValueError:
            raise ValueError("chunk size is no number") from None
        if size < 0:
            raise ValueError("chunk size is negative")
        if size == 0:
            return b"".join(out)
        piece = data[end + 2 : end + 2 + size]
        if len(piece) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(piece)
        at = end + 4 + size


def record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields,
            ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return b"".join([VERSION, b"\r\n", lines, b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data) -> Iterator[bytes]:
    """The unpacked members of a gzip file, one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        parts = [z.decompress(view[at : at + (1 << 16)])]
        end = at + (1 << 16)
        while not z.eof and end < len(view):
            parts.append(z.decompress(view[end : end + (1 << 20)]))
            end += 1 << 20
        if not z.eof:
            raise ValueError("gzip member is cut off")
        yield b"".join(parts)
        at = min(end, len(view)) - len(z.unused_data)


def parse(data: bytes) -> Iterator[tuple[dict[str, str] | str, bytes]]:
    """(fields with lower-case names, block) of each record in unpacked bytes; (fault, what is left out) for a broken one.

    Reading goes on with the next thing that begins like a record.
    """
    at = 0
    while at < len(data):
        fields, fault = {}, None
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            fault = "no WARC record here"
        else:
            for line in data[at:end].split(b"\r\n")[1:]:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            size = int(fields["content-length"]) if fields.get("content-length", "").isdecimal() else -1
            if size < 0:
                fault = "no content length"
            elif end + 4 + size > len(data):
                fault = "record is cut off"
            elif not all(fields[k].isdecimal() for k in NUMBERS if k in fields):
                fault = "a field that should be a number is none"
        if fault is None:
            yield fields, data[end + 4 : end + 4 + size]
            at = end + 4 + size + 4
            continue
        after = data.find(b"\r\n\r\nWARC/", at + 1)
        yield fault, data[at : after if after >= 0 else len(data)]
        at = after + 4 if after >= 0 else len(data)


def http_payload(block: bytes) -> tuple[bytes, int]:
    """(payload, announced length or -1) of an HTTP response: head off, chunked framing undone."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP head is cut off")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields[b"content-length"]) if b"content-length" in fields else -1
    return (unchunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body), size


# --- writing ------------------------------------------------------------------------------------

def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds _body, _first (the smallest page_id with an equal payload of at least ``min_bytes`` bytes) and _alone (whether one row has that id).

    Payloads are equal if length, SHA-1 and SHA-256 are. Shorter ones, and rows whose group has no page_id at all, have null there. The
    smallest id comes from partial aggregates, so a payload that most pages share is one row per task in that shuffle.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    key = F.concat(F.sha1("_body"), F.lit(":"), F.sha2("_body", 256), F.lit(":"), F.octet_length("_body").cast("string"))
    keyed = pages.withColumn("_body", body).withColumn("_key", key)
    first = written(
        keyed.filter((F.octet_length("_body") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("_key", "page_id").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_key").agg(F.min(F.struct("page_id", "_n")).alias("_least"), F.sum("_n").alias("_n"))
        # A payload that comes once refers to nothing.
        .filter("_n > 1").select("_key", F.col("_least.page_id").alias("_first"), (F.col("_least._n") == 1).alias("_alone")), "warc-first")
    return keyed.join(first, "_key", "left")


def record_name(job: str, page_id: int, digest: str) -> str:
    """Id of the record that holds a payload for others to refer to."""
    return f"urn:x-record:{job}:{page_id}:{digest}"


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz`` below ``folder``; one row per archive.

    A null html is an empty payload, a null url an empty target, a null page_id a record without a page id. A row with
    the smallest page_id of its payload is a response, also when that row is repeated. ``WARC-Refers-To`` of a revisit is the record id of that
    response, which no other record of any job has; where repeated rows make several such responses, no one of them is named, only the page. Other
    columns are not looked at, whatever their names; texts may be of any length (a long one is segments); an empty table gives no archives. An archive is
    closed at ``archive_bytes`` packed bytes; names depend on partition and number only, and a file is moved into place whole, so a
    task that runs twice does no harm.
    """
    spark = pages.sparkSession
    rows = with_references(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), min_bytes
    ).select("page_id", "url", "_body", "_first", "_alone")
    job = uuid.uuid4().hex[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, number, size, out, done = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def close():
            nonlocal out, size, number
            if out:
                name = f"part-{part:06d}-{number:05d}.warc.gz"
                put_file(folder, name, out)
                done.append((name, len(out), size))
                out, size, number = [], 0, number + 1

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for page_id, url, body, first, alone in zip(*columns, strict=True):
                page_id, url, body, first = page_id.as_py(), url.as_py() or "", body.as_py(), first.as_py()
                named = record_name(job, first, base32_sha1(body)) if alone.as_py() else None
                for data in _records(page_id, url, body, first, f"urn:x-row:{job}:{part}-{row}", named, segment_bytes, chunk_bytes):
                    out.append(member(data))
                    size += len(out[-1])
                    if size >= archive_bytes:
                        close()
                row += 1
        close()
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([x[0] for x in done], pa.string()),
            "n_records": pa.array([x[1] for x in done], pa.int64()),
            "n_bytes": pa.array([x[2] for x in done], pa.int64()),
        })

    schema = "file string, n_records bigint, n_bytes bigint"
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/files")
    return spark.read.schema(schema).parquet(f"{folder}/files")


def _records(page_id, url, body, first, record_id, named, segment_bytes, chunk_bytes) -> Iterator[bytes]:
    """``named``: the id of the response with this payload, if there is one alone."""
    digest = base32_sha1(body)
    fields = [("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in url)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    framed = len(body) > chunk_bytes
    coding = b"Transfer-Encoding: chunked" if framed else b"Content-Length: %d" % len(body)
    if first is not None and page_id != first:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        yield record("revisit", record_id, head, [
            *fields, ("WARC-Profile", PROFILE), *([("WARC-Refers-To", f"<{named}>")] if named else []), ("X-Refers-To-Page-ID", str(first))])
        return
    if named:
        record_id = named
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + coding + b"\r\n\r\n"
    block = head + (chunked(body, chunk_bytes) if framed else body)
    if len(block) <= segment_bytes:
        yield record("response", record_id, block, fields)
        return
    starts = range(0, len(block), segment_bytes)
    for n, at in enumerate(starts, 1):
        extra = [("WARC-Segment-Number", str(n))]
        if n > 1:
            extra.append(("WARC-Segment-Origin-ID", f"<{record_id}>"))
        if n == len(starts):
            extra.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("response" if n == 1 else "continuation", record_id if n == 1 else f"{record_id}:{n}",
                     block[at : at + segment_bytes], [*(fields if n == 1 else []), *extra])


# --- reading ------------------------------------------------------------------------------------

RAW = ("file string, record_id string, record_type string, segment int, total bigint, target string, page_id bigint, "
       "refers_to bigint, digest string, block binary, error string")
PAGE = ("record_id string, page_id bigint, target string, record_type string, refers_to bigint, "
        "payload_bytes bigint, payload_digest string, payload binary, error string")


def _row(file: str, fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if fields.get(k, "").removeprefix("-").isdecimal() else None
    return (
        file, fields.get("warc-segment-origin-id", fields.get("warc-record-id", "")).strip("<>"), fields.get("warc-type"),
        number("warc-segment-number"), number("warc-segment-total-length"), fields.get("warc-target-uri"), number("x-page-id"),
        number("x-refers-to-page-id"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), block, None,
    )


def read_records(spark, folder: str, pattern: str = "*.warc*") -> DataFrame:
    """One row per record of the archives: ``RAW``. A broken record is a row with ``error``, and reading goes on behind it.

    ``record_id`` of a continuation is that of its origin.
    """
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    names = [x.split(" ")[0] for x in RAW.split(", ")]

    def batch(rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for path, data in zip(got.column(0), got.column(1), strict=True):
                file, rows, size = path.as_py().rpartition("/")[2], [], 0
                raw = data.as_buffer()
                try:
                    for unpacked in members(raw) if bytes(raw[:2]) == b"\x1f\x8b" else [bytes(raw)]:
                        for fields, block in parse(unpacked):
                            rows.append(_row(file, fields, block) if isinstance(fields, dict) else (file, *[None] * 9, fields))
                            size += len(block)
                            if size > 8 << 20:
                                yield batch(rows)
                                rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    # Packed bytes that cannot be read on hide where the next member begins.
                    rows.append((file, *[None] * 9, str(e) or type(e).__name__))
                if rows:
                    yield batch(rows)

    return content.mapInArrow(run, RAW)


def reassemble(records: DataFrame) -> DataFrame:
    """``PAGE`` rows: one per logical record. Only cut records are shuffled, by origin id."""
    whole = records.filter(F.col("segment").isNull())
    parts = (
        records.filter(F.col("segment").isNotNull()).groupBy("record_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("_parts"), F.max("total").alias("total"),
            *[F.max_by(c, F.when(F.col("segment") == 1, 1)).alias(c) for c in ("record_type", "target", "page_id", "refers_to", "digest")],
        )
        .withColumn("_numbers", F.col("_parts.segment"))
        .withColumn("_length", F.aggregate("_parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["block"])))
        .withColumn("error", F.when(F.col("record_type").isNull(), "first segment is missing")
                    .when(F.col("_numbers") != F.sequence(F.lit(1), F.size("_numbers")), "segments are missing or repeated")
                    .when(F.col("total").isNull(), "last segment is missing")
                    .when(F.col("total") != F.col("_length"), "length differs from the total length"))
        .withColumn("blocks", F.col("_parts.block"))
    )
    columns = ["record_id", "record_type", "target", "page_id", "refers_to", "digest", "blocks", "error"]
    logical = whole.withColumn("blocks", F.array("block")).select(*columns).unionByName(parts.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            sizes, digests, payloads, errors = [], [], [], []
            for kind, block, stated, error in zip(*[got.column(c) for c in ("record_type", "blocks", "digest", "error")], strict=True):
                kind, stated, error = kind.as_py(), stated.as_py(), error.as_py()
                payload, size, digest = None, None, stated or None
                if error is None and kind in ("response", "revisit"):
                    try:
                        payload, announced = http_payload(b"".join(block.as_py()))
                        if kind == "revisit":
                            payload, size = None, announced
                        else:
                            size, digest = len(payload), base32_sha1(payload)
                            if announced not in (-1, size):
                                error = "payload differs from the announced length"
                            elif stated and stated != digest:
                                error = "payload differs from its digest"
                    except ValueError as e:
                        error = str(e)
                sizes.append(size)
                digests.append(digest)
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([
                got.column("record_id"), got.column("page_id"), got.column("target"), got.column("record_type"), got.column("refers_to"),
                pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary()),
                pa.array(errors, pa.string())], [x.split(" ")[0] for x in PAGE.split(", ")])

    return logical.mapInArrow(run, PAGE)


def round_trip(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write ``pages`` to a new folder below the shared one and read the archives back."""
    folder = job_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes, **options).count()
    return reassemble(read_records(pages.sparkSession, folder, "*.warc.gz"))
