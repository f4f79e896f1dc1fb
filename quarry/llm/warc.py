"""WARC archives: writing, and a splittable reader.

Each record is a gzip member of its own. The reader gives every task a byte range. A task scans its range for the gzip magic,
tries each candidate by decoding the member's beginning and looking for a WARC version line, and owns the records that start
inside its range, reading past its end for the last one. A magic that is only chance bytes inside another member fails that
test. So archives of any size are read in parallel without an index.

Files are listed and sized by Spark; ranges are read by pyarrow's file systems, which know the shared folder. A store that
only Spark's readers open can't be read in ranges; there, ``whole=True`` has Spark's binaryFile reader hand over whole files,
whose ranges are then scanned in the same way.

Records that repeat a payload become revisits of the response with the largest id. Payloads meet in their SHA-1: an
aggregation keeps the largest id of each digest, and joins it back without a hint, so a hot payload's rows are split at run
time. A task writes files of its own names; those of the task attempts that Spark accepts are named, with their sizes, in a manifest,
a table beside the files that Spark commits as any other. Readers of the folder read what the manifest names, so files of a task that
was lost or run twice don't count, and nothing is renamed or listed on the driver.

Defined results: null payloads are empty; rows tied at the largest id of a payload are all responses; a null id makes a row a
revisit if an equal payload has an id, else a response without a number; an empty table gives an archive without files,
which reads as no rows; members that are damaged or cut are skipped, as are records without a WARC version line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.shared import shared_dir, shared_table

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, bytes read at once, and bytes of a member that must hold the version line.
RANGE, READ, PROBE = 8 << 20, 1 << 20, 512
#: Records are spread so that a file takes about this many bytes of payload.
FILE_BYTES = 64 << 20
_ID, MANIFEST = "urn:quarry:page:", "_manifest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return pack.compress(data) + pack.flush()


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Writes a folder of .warc.gz files. Payloads of under least_bytes bytes are always responses."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    largest = shared_table(rows.select("sha", "page").groupBy("sha").agg(F.max("page").alias("largest"), F.count("*").alias("n")))
    alike = largest.where((F.col("n") > 1) & F.col("largest").isNotNull()).select("sha", "largest")
    marked = rows.join(alike, "sha", "left")
    again: Column = F.col("largest").isNotNull() & (F.col("size") >= least_bytes) & (F.coalesce(F.col("page"), F.lit(None).cast("long")).isNull() | (F.col("page") < F.col("largest")))
    marked = marked.select(
        "page", "url", "size", F.col("sha"), F.when(again, F.col("largest")).alias("refers_to"), again.alias("again"),
        F.when(~again, F.col("payload")).alias("payload"),
    )

    def named(out: pa.NativeFile, name: str) -> pa.RecordBatch:
        size = out.tell()
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["file", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                for page, uri, n, sha, refers_to, again_, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record("revisit" if again_ else "response", page, uri, payload or b"", n, base64.b32encode(sha).decode(), refers_to))
                    size += len(payload or b"")
                    if size >= FILE_BYTES:
                        yield named(out, name)
                        out, size = None, 0
            if out is not None:
                yield named(out, name)
        finally:
            if out is not None and not out.closed:
                out.close()

    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    marked.mapInArrow(run, "file string, bytes long").write.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def _members(read: Callable[[int, int], bytes], start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that start in start..end of a file; read(offset, length)."""
    at = start
    window, base = b"", start
    while at < end:
        if at - base >= len(window) - 2 or base > at:
            base, window = at, read(at, READ)
            if len(window) < len(MAGIC):
                return
        k = window.find(MAGIC, at - base)
        if k < 0:
            at = base + max(1, len(window) - 2)
            if base + len(window) >= size:
                return
            base, window = at, read(at, READ)
            continue
        here = base + k
        if here >= end:
            return
        content, stop = _decoded(read, here, size)
        if content is None:
            at = here + 1
        else:
            yield here, content
            at = stop


def _decoded(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[bytes | None, int]:
    """The member at an offset, and where it ends; None if it isn't a whole WARC record."""
    unpack = zlib.decompressobj(31)
    parts, got, checked = [], 0, False
    first, position = True, at
    while position < size:
        data = read(position, 65536 if first else READ)
        first = False
        if not data:
            return None, at
        try:
            parts.append(unpack.decompress(data))
        except zlib.error:
            return None, at
        got += len(parts[-1])
        if not checked and (got >= PROBE or unpack.eof):
            if not re.match(rb"WARC/\d+\.\d+\r?\n", b"".join(parts)[:PROBE]):
                return None, at
            checked = True
        position += len(data)
        if unpack.eof:
            return b"".join(parts), position - len(unpack.unused_data)
    return None, at


def parsed(content: bytes) -> dict:
    """Fields of a record; the HTTP header is taken off the payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    said = fields.get("content-length", "")
    block = rest[: int(said)] if said.isascii() and said.isdigit() else rest
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = lambda s: int(m[1]) if (m := re.fullmatch(rf"<{_ID}(-?\d+)>", s or "")) else None
    return {
        "type": fields.get("warc-type"), "page": number(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "refers_to": number(fields.get("warc-refers-to")),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "size": int(length[1]) if length else len(payload), "payload": payload,
    }


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE, whole: bool = False) -> DataFrame:
    """Returns one row per record: file, start, type, page, uri, refers_to, digest, size (of the full payload) and payload."""
    kinds = {
        "file": pa.string(), "start": pa.int64(), "type": pa.string(), "page": pa.int64(), "uri": pa.string(), "refers_to": pa.int64(), "digest": pa.string(),
        "size": pa.int64(), "payload": pa.binary(),
    }
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    here = path.rstrip("/")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{here}/{MANIFEST}")
    if not whole and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        named = spark.read.schema("file string, bytes long").parquet(f"{here}/{MANIFEST}")
        files = named.select(F.concat(F.lit(f"{here}/"), "file").alias("path"), F.col("bytes").alias("length"))
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    if whole:
        ranges = files.select("path", "length", "content", F.lit(0).cast("long").alias("start"))
    else:
        ranges = files.select("path", "length", starts)
        ranges = ranges.repartition(max(1, min(10_000, spark.sparkContext.defaultParallelism * 8)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if whole:
                    content = r["content"]
                    yield from rows(r, lambda at, n, content=content: content[at : at + n], r["length"])
                    continue
                system, name = fs.FileSystem.from_uri(r["path"])
                with system.open_input_file(name) as f:
                    yield from rows(r, lambda at, n, f=f: f.read_at(max(0, min(n, f.size() - at)), at), r["start"] + range_bytes)

    def rows(r: dict, read: Callable[[int, int], bytes], end: int) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for at, content in _members(read, r["start"], min(end, r["length"]), r["length"]):
            found.append({"file": r["path"], "start": at} | parsed(content))
            held += len(content)
            if held >= 8 << 20:
                yield pa.RecordBatch.from_pylist(found, pa.schema(kinds.items()))
                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema(kinds.items()))

    return ranges.mapInArrow(run, ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder, as a URI."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
