"""WARC records in ZIP packages: written by the tasks, read back by ranges.

A writing task packs its records into ZIP files with stored members: ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdxj`` (a line with offset and length for each record).
Equal payloads of ``REVISIT_BYTES`` or more are written once; the other records are revisits that
name the first by its record id and carry the payload's digest and length.

The reader parses the end record, the ZIP64 end record where there is one, and the central directory,
finds the members' places in the file, reads the indexes, and hands ranges of records to tasks,
which read just these ranges. Nothing is extracted. Files are opened by their URI through
``pyarrow.fs`` in the shared folder that the cluster names; a task's attempt writes files of
its own names and only a finished task's names are in the manifest, so a lost executor leaves
stray files but no double records.
"""

from __future__ import annotations

import math
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import prepare, scratch_path, stored
from quillscope.llm.components import small

REVISIT_BYTES = 100
ROLL_BYTES = 1 << 30  # payload bytes after which a task begins another package
RANGE_BYTES = 8 << 20  # records of one stretch of a package go to one task
DATE = "2024-01-01T00:00:00Z"  # fixed, so reruns write equal records
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the file system that Spark would take it from, settled on the driver:
    a path without a scheme is on the cluster's default file system, not on an executor's own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the place there of a qualified path. (A path without a scheme is this process's own; jobs
    qualify theirs first.)"""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


class _Out:
    """A stream that zipfile can't seek in."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def write(self, b) -> int:
        self.f.write(b)
        self.at += len(b)
        return len(b)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def record(page: str | None, uri: str, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, gzipped."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(uri.split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Packages under ``folder``; returns the written manifest ``(archive, records)``.

    Null payloads are empty, a null url is an empty one. Of rows with equal payloads of at least
    ``REVISIT_BYTES`` bytes those with the least id are responses and the others, also such of null
    id, revisits; if all ids are null, all are responses.
    """
    prepare(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    several = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.count("*").alias("_n"), F.min("id").alias("first"))
        .where("_n > 1 and first is not null")
        .drop("_n")
    )
    rows = rows.join(small(stored(several, "payloads")), F.col("digest") == F.col("_digest"), "left")
    rows = rows.select(
        F.col("id").cast("string").alias("id"),
        "url",
        "payload",
        "digest",
        F.col("first").cast("string").alias("first"),
        (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            for page, url, payload, digest, first, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if package is not None and package.bytes > ROLL_BYTES:
                    yield package.close()
                    package = None
                if package is None:
                    package = _Package(folder)
                package.add(page, record(page, url, payload, digest, first, revisit), len(payload))
        if package is not None:
            yield package.close()

    return stored(rows.mapInArrow(run, "archive string, records long"), "manifest")


class _Package:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = open_fs(self.path)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Out(self.file), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines, self.at, self.bytes = [], 0, 0

    def add(self, page: str | None, data: bytes, size: int) -> None:
        self.member.write(data)
        self.lines.append(json.dumps({"page": page, "offset": self.at, "length": len(data)}))
        self.at += len(data)
        self.bytes += size

    def close(self) -> pa.RecordBatch:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([len(self.lines)], pa.int64())], names=["archive", "records"])


class Member(NamedTuple):
    name: str
    method: int
    size: int  # bytes in the file
    header: int  # place of the local header


def central_directory(f, size: int) -> list[Member]:
    """The members of a ZIP or ZIP64 file from its central directory. ``f``: a seekable file."""
    tail_at = max(0, size - 22 - 65_535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = len(tail)
    while True:  # the last end record whose comment reaches the end of the file
        end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        if len(tail) >= end + 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    _, _, _, entries, length, at = struct.unpack_from("<4H2I", tail, end + 4)
    if 0xFFFF in (entries,) or 0xFFFFFFFF in (length, at):
        f.seek(tail_at + end - 20)
        locator = f.read(20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", locator, 8)[0])
        record64 = f.read(56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, at = struct.unpack_from("<3Q", record64, 32)
    f.seek(at)
    data, out, p = f.read(length), [], 0
    for _ in range(entries):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack_from("<2H", data, p + 8)
        packed, whole = struct.unpack_from("<2I", data, p + 20)
        n, extra, comment = struct.unpack_from("<3H", data, p + 28)
        header = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, k = struct.unpack_from("<2H", data, q)
            if kind == 1:  # ZIP64: only the fields that are full in the directory, in this order
                fields = iter(struct.unpack_from(f"<{k // 8}Q", data, q + 4))
                if whole == 0xFFFFFFFF:
                    whole = next(fields)
                if packed == 0xFFFFFFFF:
                    packed = next(fields)
                if header == 0xFFFFFFFF:
                    header = next(fields)
            q += 4 + k
        out.append(Member(name, method, packed, header))
        p = stop + comment
    return out


def data_offset(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} isn't stored, so it can't be read by ranges")
    f.seek(m.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, extra = struct.unpack_from("<2H", head, 26)
    return m.header + 30 + n + extra


def locate(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record of a package, by all its indexes (plain or gzipped).

    A line's ``filename`` names its archive, which may be left out where the package holds only one.
    """
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        members = [m for m in central_directory(f, f.size()) if not m.name.endswith("/")]
        base = {m.name: data_offset(f, m) for m in members if m.name.startswith("archive/")}
        indexes = [m for m in members if m.name.startswith("indexes/") and m.size]
        listed = {m.name.removeprefix("indexes/") for m in indexes}
        for m in indexes:
            f.seek(data_offset(f, m))
            lines = f.read(m.size)
            if lines[:2] == b"\x1f\x8b":
                lines = gzip.decompress(lines)
            for line in lines.split(b"\n"):
                _, brace, fields = line.partition(b"{")  # a key and a date may stand before the fields
                if not brace:
                    continue
                entry = json.loads(brace + fields)
                name = entry.get("filename")
                if name is None:
                    if len(base) != 1:
                        raise ValueError(f"{path}: a line of {m.name} names none of {len(base)} archives")
                    at = next(iter(base.values()))
                elif name.removeprefix("indexes/") in listed:
                    continue  # an index of an index
                else:
                    at = base["archive/" + name.removeprefix("archive/")]
                yield at + int(entry["offset"]), int(entry["length"])


def parse(data: bytes) -> dict:
    """One gzipped record: its headers, and the payload of a response."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    page = lambda urn: urn.strip("<>").removeprefix("urn:page:") if urn and "urn:page:" in urn else None
    kind = warc["WARC-Type"]
    return {
        "page": page(warc["WARC-Record-ID"]),
        "url": warc["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": page(warc.get("WARC-Refers-To")),
        "payload_bytes": len(payload) if kind == "response" else int(fields["Content-Length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else warc["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if kind == "response" else None,
    }


RECORD = T.StructType(
    [
        T.StructField("page", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(manifest: DataFrame, archive_col: str = "archive", columns: list[str] | None = None) -> DataFrame:
    """The records of the packages named in ``manifest``: ``columns`` of ``RECORD`` (default all).

    A first pass reads directories and indexes; its (package, offset, length) rows are dealt out by
    stretches of the package, so one large package is read by many tasks. An empty manifest gives none.
    """
    prepare(manifest.sparkSession)
    schema = RECORD if columns is None else T.StructType([RECORD[c] for c in columns])

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(locate(path))
                for i in range(0, len(rows), 50_000):
                    some = rows[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(some)), pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64())],
                        names=["archive", "offset", "length"],
                    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        kinds = pa.schema([(s.name, {"long": pa.int64(), "binary": pa.binary()}.get(s.dataType.simpleString().replace("bigint", "long"), pa.string())) for s in schema])
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if path != name:
                    if f is not None:
                        f.close()
                    fs, p = open_fs(path)
                    name, f = path, fs.open_input_file(p)
                r = parse(f.read_at(length, offset))
                rows.append({k: r[k] for k in kinds.names})
                held += r["payload_bytes"] if "payload" in kinds.names else 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)
        if f is not None:
            f.close()

    a = F.col(f"`{archive_col}`")
    here = qualified(manifest.sparkSession, "/").rstrip("/")  # e.g. file: or hdfs://name
    whole = F.when(a.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), a).otherwise(F.concat(F.lit(here + "/"), F.ltrim(a, F.lit("/"))))
    pointers = stored(manifest.select(whole.alias("archive")).mapInArrow(point, "archive string, offset long, length long"), "pointers")
    # neighbours go to one task, as many tasks as there are stretches, however few bytes the pointers have
    total = pointers.agg(F.sum("length")).first()[0] or 0
    tasks = max(math.ceil(total / RANGE_BYTES), manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = pointers.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(fetch, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every record, from the written packages."""
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    manifest = write_archives(pages, scratch_path(spark, "warc"), id_col, url_col, payload_col)
    kind = dict(pages.dtypes)[id_col]
    rows = read_archives(manifest, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return rows.select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to FROM r
"""
