"""WARC archives: writing captures, and assembling transactions from the records of archives.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the
response in WARC-Concurrent-To. Reading parses the files record by record, in any order,
and joins the three through these identifiers into one nested row per capture. A request or metadata record whose
response is missing gives a row without response, and a response without the others one without them.

Of captures with equal payloads of at least min_revisit bytes, the one with the largest id is the
response and the others revisit it.

Archives are .warc.gz files with one gzip member per record, so that a record can be read by its offset, each
beginning with a warcinfo record and cut by bytes. They go through Spark's text writer, so through its commit of whole
tasks, into any store that Spark writes to: the last byte of a member, zero below 16 MB of record, is left out, and the
writer's line separator, one zero byte, puts it back. After a larger record it is padding, which readers of gzip skip.
Reading takes archives of up to WHOLE_BYTES through Spark, and streams larger ones from Arrow's file systems.

Defined cases: a null page counts as empty; a very long one is a record of its size, and a file may exceed its limit by one
capture; a null address has no WARC-Target-URI; a capture without an id revisits one of its group that has one; if none
has, all are responses; repeated rows of the largest id are all responses; other repeated rows are captures of
their own; an empty table gives no captures; other columns of pages are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.llm.common import materialize, ready_for_python, scratch_path, slices

#: Compressed bytes of an archive before the next begins, and of one that is read as a whole.
FILE_BYTES, WHOLE_BYTES = 64 << 20, 128 << 20
#: Rows handed to Spark at a time while a file is parsed, and bytes of payload.
CHUNK_ROWS, CHUNK_BYTES = 1000, 8 << 20

RECORD = pa.schema(
    [
        ("file", pa.string()),
        ("number", pa.int64()),
        ("type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("digest", pa.string()),
        ("http", pa.string()),
        ("http_length", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha1", pa.string()),
        ("page_id", pa.int64()),
        ("payload", pa.binary()),
    ]
)
RECORD_DDL = (
    "file string, number long, type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, "
    "http string, http_length long, payload_bytes long, payload_sha1 string, page_id long, payload binary"
)


def _identifier(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record; a header whose value is null is left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(*lines, length, block, F.lit("\r\n\r\n"))


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Write one capture per row of pages into archives under path."""
    ready_for_python(pages.sparkSession)
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\r\n]+", " ").alias("__url"), html.alias("__html"))
    keyed = base.withColumn("__sha", F.sha1("__html"))
    shared = (
        keyed.filter(F.octet_length("__html") >= min_revisit)
        .groupBy(F.col("__sha").alias("sha"))
        .agg(F.count("*").alias("n"), F.max("__id").alias("first"))
        .filter("n > 1 and first is not null")
        .select("sha", "first")
    )
    rows = keyed.join(materialize(shared, "payloads"), F.col("__sha") == F.col("sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    # The one that others revisit is named by its id and payload alone; all others' names hold a number of their own.
    named = F.when(F.col("__id").eqNullSafe(F.col("first")), F.lit("")).otherwise(F.monotonically_increasing_id().cast("string"))
    own = F.col("__own")
    rows = rows.withColumn("__own", _identifier(F.lit("capture"), F.coalesce(F.col("__id").cast("string"), F.lit("none")), F.col("__sha"), F.when(F.col("first").isNull(), F.monotonically_increasing_id().cast("string")).otherwise(named)))
    first = F.when(revisit, _identifier(F.lit("capture"), F.col("first").cast("string"), F.col("__sha"), F.lit("")))
    when, sha = F.lit(date), F.concat(F.lit("sha1:"), F.col("__sha"))
    n = F.octet_length("__html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    ask = F.concat(F.lit("GET "), F.coalesce("__url", F.lit("/")), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    about = F.concat(F.lit("via: crawl\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("__id").cast("string"), F.lit("\r\n")), F.lit("")))
    common = [("WARC-Target-URI", F.col("__url")), ("WARC-Date", when)]
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    records = F.array(
        _record(F.lit("request"), [("WARC-Record-ID", _identifier(F.lit("request"), own)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http;msgtype=request"))], ask),
        _record(
            kind,
            [("WARC-Record-ID", own), *common, ("WARC-Refers-To", first), ("WARC-Profile", profile), ("WARC-Payload-Digest", sha), ("Content-Type", F.lit("application/http;msgtype=response"))],
            F.when(revisit, http).otherwise(F.concat(http, F.col("__html"))),
        ),
        _record(F.lit("metadata"), [("WARC-Record-ID", _identifier(F.lit("metadata"), own)), ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))], about),
    )
    members = rows.select(F.transform(records, lambda r: r.cast("binary")).alias("records")).mapInArrow(
        lambda batches: _members(batches, date, file_bytes), "part int, number long, value binary"
    )
    in_order = members.sortWithinPartitions("part", "number").select("part", F.col("value").cast("string").alias("value"))
    in_order.write.partitionBy("part").option("lineSep", "\0").text(path)
    _rename(pages.sparkSession, path)


def _members(batches: Iterator[pa.RecordBatch], date: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Gzip members of records, without their last byte where that is zero, and the number of the file they belong to."""
    info = b"software: hopwise\r\nformat: WARC File Format 1.1\r\n"
    part, size, number = -1, file_bytes, 0
    for batch in slices(batches):
        parts, values = [], []
        for records in batch.column(0).to_pylist():
            if size >= file_bytes:
                part, size = part + 1, 0
                name = hashlib.md5(b"".join(records)).hexdigest()
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>\r\nWARC-Date: {date}\r\n"
                records = [f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", *records]
            for record in records:
                member = gzip.compress(record, 6, mtime=0)
                size += len(member)
                parts.append(part)
                values.append(member[:-1] if member[-1] == 0 else member)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(range(number, number + len(parts)), pa.int64()), pa.array(values, pa.binary())], names=["part", "number", "value"])
        number += len(parts)


def _rename(spark: SparkSession, path: str) -> None:
    """Give the files that the text writer has made under path the ending of archives."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = store.listFiles(folder, True), []
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().endswith(".txt"):
            files.append(file)
    with ThreadPoolExecutor(16) as pool:
        for done in pool.map(lambda f: store.rename(f, jvm.org.apache.hadoop.fs.Path(f.getParent(), f.getName().removesuffix(".txt") + ".warc.gz")), files):
            if not done:
                raise OSError(f"{path}: a file can't be renamed")


def parse(file: str, source: io.BufferedIOBase, keep_payload: bool) -> Iterator[dict]:
    """The records of an archive, gzip or plain, read as a stream. Blocks are read by their length, whatever is in them."""
    raw = io.BufferedReader(source, 1 << 20)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    number = 0
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: a record should begin, but there is {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{file}: record {number} is cut off")
        kind = headers.get("warc-type")
        row = dict.fromkeys(RECORD.names)
        row |= {
            "file": file, "number": number, "type": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "digest": (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        }
        if kind in ("response", "revisit", "request"):
            head, _, body = block.partition(b"\r\n\r\n")
            row["http"] = head.decode("utf-8", "replace")
            for field in head.split(b"\r\n")[1:]:
                name, _, value = field.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    row["http_length"] = int(value)
            if kind == "response":
                row |= {"payload_bytes": len(body), "payload_sha1": hashlib.sha1(body).hexdigest(), "payload": body if keep_payload else None}
        elif kind == "metadata":
            for field in block.split(b"\r\n"):
                name, _, value = field.partition(b":")
                if name == b"page-id":
                    row["page_id"] = int(value)
        yield row
        number += 1


def records(spark: SparkSession, path: str, keep_payload: bool = True, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row per record of the archives (*.gz, *.warc) under path."""
    ready_for_python(spark)

    def rows_of(file: str, source: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in parse(file, source, keep_payload):
            held.append(row)
            size += len(row["payload"] or b"")
            if len(held) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist(held, RECORD)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, RECORD)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from rows_of(file, pa.BufferReader(content.as_buffer()))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(file)
                with store.open_input_stream(inner, compression=None) as source:
                    yield from rows_of(file, source)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", "content")
    large = files.filter(F.col("length") > whole_bytes).select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"))
    return small.mapInArrow(whole, RECORD_DDL).union(large.mapInArrow(streamed, RECORD_DDL))


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture, uri, date, request, response (or revisit) and metadata; null for what is missing.

    Records that name the same response are told apart by their order in the archives, so repeated
    captures stay apart. found: as records() gives them; it is read three times, so archives are better parsed into a table before.
    """
    answer = F.col("type").isin("response", "revisit")
    told = (
        found.filter(answer | F.col("type").isin("request", "metadata"))
        .withColumn("capture", F.when(answer, F.col("record_id")).otherwise(F.col("concurrent_to")))
        .withColumn("role", F.when(answer, F.lit("response")).otherwise(F.col("type")))
    )
    told = told.withColumn("nth", F.row_number().over(W.partitionBy("capture", "role").orderBy("file", "number")))

    def part(role: str, *fields: str) -> DataFrame:
        return told.filter(F.col("role") == role).select("capture", "nth", F.struct("uri", "date").alias(f"{role}_head"), F.struct(*fields).alias(role))

    answers = part("response", "type", "record_id", "refers_to", "digest", "http", "http_length", "payload_bytes", "payload_sha1", "payload")
    both = answers.join(part("request", "record_id", "http"), ["capture", "nth"], "full")
    every = both.join(part("metadata", "record_id", "page_id"), ["capture", "nth"], "full")
    head = F.coalesce("response_head", "request_head", "metadata_head")
    return every.select("capture", head["uri"].alias("uri"), head["date"].alias("date"), "request", "response", "metadata")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", min_revisit: int = 1000, path: str | None = None) -> DataFrame:
    """Write pages, read the archives back, and tell for each capture its payload's size, digest and kind."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, id_col=id_col, min_revisit=min_revisit)
    found = materialize(records(spark, path, keep_payload=False), "records")  # parsed once, for three joined parts
    whole = materialize(captures(found).filter("response is not null").select(
        "capture",
        F.col("metadata.page_id").alias(id_col),
        F.coalesce("response.payload_bytes", "response.http_length").alias("payload_bytes"),
        F.coalesce("response.payload_sha1", "response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
    ), "captures")
    revisited = whole.filter("record_type = 'revisit'").select(F.col("target").alias("capture")).distinct()
    named = materialize(whole.filter("record_type = 'response'").join(revisited, "capture", "left_semi").groupBy("capture").agg(F.max(id_col).alias("refers_to")), "revisited")
    return whole.join(named.withColumnRenamed("capture", "target"), "target", "left").select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to")
