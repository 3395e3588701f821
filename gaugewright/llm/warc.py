"""WARC archives: writing captures, reading records, and assembling transactions.

Writing: each capture becomes a request, a response (or, if an equal payload of
at least min_revisit_bytes has a smaller page_id, a revisit) and a metadata
record; the request and the metadata name the response in WARC-Concurrent-To.
Every task writes its own files to the shared folder under a name of its
attempt, and only files that a successful task reports are ever read, so lost
executors and second attempts leave no half archive behind. Reading streams one
file a task, record by record. Assembly joins the records on the concurrent-to
identifiers and gives one nested row for each capture.

Defined cases: a null html is an empty payload; a null url leaves the target
header out and reads back as null; rows that repeat a page_id are captures of
their own, all responses if theirs is the smallest page_id of the payload, and
their revisits name the page alone, not one of its records; a null
page_id is only a response if no other row has the payload; an empty table makes
no files and no rows; extra columns are not read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm.store import keep, new_path

MIN_REVISIT_BYTES = 0
FILE_BYTES = 128 << 20  # of compressed records, after which a task begins its next file
LEVEL = 1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
_RECORDS = "path string, record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, fields map<string,string>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ':'.join(map(str, parts)))}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))] if v is not None)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = f.read(size)
            if len(block) != size:
                raise ValueError("an archive ends within a record")
            yield headers, block


def _line(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _body(html: F.Column) -> F.Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _plan(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """For each distinct page_id and payload: page_id, the page_id that it revisits (null: a response), and whether each stands on several rows."""
    body = _body(F.col("html"))
    marks = keep(pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("n")), "warc-marks")
    first = marks.filter(F.col("n") >= min_revisit_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    plan = marks.join(first, ["sha", "n"], "left").select("page_id", "sha", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None).cast("long")).otherwise(F.col("first")).alias("revisits"))
    often = marks.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own, target = often.select(F.col("page_id").alias("own"), F.lit(True).alias("repeated")), often.select(F.col("page_id").alias("target"))
    plan = plan.distinct().join(own, F.col("page_id").eqNullSafe(F.col("own")), "left").join(target, F.col("revisits") == F.col("target"), "left")
    return plan.select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "revisits", F.coalesce("repeated", F.lit(False)).alias("repeated"), F.col("target").isNotNull().alias("vague"))


def write(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives; the manifest (path, records) of the files, once they are there."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    plan = _plan(src, min_revisit_bytes)
    rows = src.join(plan, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(_body(F.col("html"))) == F.col("__sha")), "left").select("page_id", "url", "html", "revisits", "repeated", "vague")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        done: list[tuple[str, int]] = []
        out, size, count, copy = None, 0, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count))
                out = None

        for b in batches:
            for page_id, url, html, revisits, repeated, vague in zip(*(x.to_pylist() for x in b.columns), strict=True):
                copy += 1
                if out is None:
                    path, size, count = f"{root}/{name}-{len(done):04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                body = (html or "").encode()
                # rows of a repeated page_id may be in several tasks: their place tells them apart
                own = ("capture", page_id, task.partitionId(), copy) if repeated else ("capture", page_id)
                capture, sha, uri = _id(*own), digest(body), _line(url)
                date = ("WARC-Date", "2024-01-01T00:00:00Z")
                target = ("WARC-Target-URI", uri)
                reply = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                ask = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
                common = [("WARC-Record-ID", capture), date, target, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
                if revisits is None:
                    main = record("response", common, reply + body)
                else:
                    main = record("revisit", [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", None if vague else _id("capture", revisits))], reply)
                facts = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(body)}\r\nrefers-to-page: {'' if revisits is None else revisits}\r\n".encode()
                data = main + record("request", [("WARC-Record-ID", _id("request", *own)), date, target, ("WARC-Concurrent-To", capture), ("Content-Type", "application/http;msgtype=request")], ask)
                data += record("metadata", [("WARC-Record-ID", _id("metadata", *own)), date, target, ("WARC-Concurrent-To", capture), ("Content-Type", "application/warc-fields")], facts)
                out.write(data)
                size, count = size + len(data), count + 3
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    made = rows.mapInArrow(run, "path string, records long").withColumn("folder", F.lit(folder))
    return keep(made, "warc-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest: one row each; payload digests are taken anew from the payloads read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *[(x, pa.string()) for x in ("record_id", "type", "concurrent_to", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                out: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as raw:
                    for h, block in read_records(io.BufferedReader(raw, 1 << 20) if not hasattr(raw, "peek") else raw):
                        kind, size, sha, fields = h["warc-type"], None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, []
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, found = len(payload), digest(payload)
                            if sha != found:
                                raise ValueError(f"{path}: a payload differs from its digest")
                        elif kind == "metadata":
                            fields = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)]
                        out.append((path, h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), sha, size, fields))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    parts = max(1, min(manifest.count(), 10_000))  # one archive a task
    return manifest.select("path", "folder").repartition(parts).mapInArrow(run, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and metadata records concurrent to it."""
    part = lambda *kinds: records.filter(F.col("type").isin(*kinds))
    main = part("response", "revisit").select("record_id", F.struct("record_id", "type", "target_uri", "refers_to", "payload_digest", "payload_bytes").alias("response"))
    ask = part("request").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "target_uri").alias("request"))
    facts = part("metadata").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("record_id"), "fields").alias("metadata"))
    return main.join(ask, "record_id", "left").join(facts, "record_id", "left").withColumnRenamed("record_id", "capture_id")


def captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages, read the archives back and give the digest of each capture."""
    nested = assemble(keep(read(pages.sparkSession, write(pages, min_revisit_bytes)), "warc-records"))
    field = lambda name: F.when(F.col("metadata.fields")[name] != "", F.col("metadata.fields")[name]).cast("long")
    return nested.select(field("page-id").alias("page_id"), F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), field("refers-to-page").alias("refers_to"))
