"""Deterministic sharded WARC writer, and a reader of its archives.

Records are range-sorted by page id. Each task writes its range as files rolled by compressed
size, under a temporary name that is renamed when the file is whole, and reports the file and its
digest; the manifest, written last and renamed into place, names the files that belong. A retried
or speculative task writes the same bytes to the same names, and leftovers of lost attempts are
not in the manifest. Headers and digests are generated from the record, never copied.

Equal payloads are stored once: of the rows with one SHA-1, that with the largest page id holds
the payload and the others are revisits of it. Payloads below ``min_revisit_bytes`` are always
stored.

Edge cases. Null html: the empty payload. Null url: no target URI. Null page id: stored as a
response that never refers and is never referred to. Rows repeated with one page id and payload:
one is the response, the others revisit it. Extra columns are ignored. An empty table writes an
empty manifest and reads back as no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.runtime import shared_dir, ship, shuffle_width

ROLL_BYTES = 64 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
_RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _b32(hex_digest: str) -> str:
    return base64.b32encode(binascii.unhexlify(hex_digest)).decode()


def _record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}/{digest}/{nth}'.encode()).digest()[:16], version=5)}>"


def _record(page_id, url, payload: bytes, digest: str, nth: int, refers: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, nth)}",
        f"WARC-Date: {DATE}",
    ]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers, digest, 0)}", f"WARC-X-Refers-To-Page-ID: {refers}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


class _Roller:
    """Files of one range, each written whole under a temporary name and then renamed."""

    def __init__(self, uri: str, part: int, roll: int):
        self.fs, self.root = _store(uri)
        self.part, self.roll, self.nth, self.out = part, roll, 0, None
        self.done: list[tuple[int, str, int, int, str]] = []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.nth:05d}.warc.gz"
            self.temp = posixpath.join(self.root, "_temporary", f"{self.name}.{uuid.uuid4().hex}")
            self.out = self.fs.open_output_stream(self.temp)
            self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.size += len(member)
        self.records += 1
        self.sum.update(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, posixpath.join(self.root, self.name))
            self.done.append((self.part, self.name, self.records, self.size, self.sum.hexdigest()))
            self.out, self.nth = None, self.nth + 1


def _write(uri: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files = _Roller(uri, TaskContext.get().partitionId(), roll)
        last, nth, target = None, 0, None
        for batch in batches:
            for page_id, url, html, sha, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "target")), strict=True):
                if html is None:  # stands before its pages: the page that holds their payload
                    last, nth, target = (page_id, sha), -1, keeper
                    continue
                if (page_id, sha) != last:
                    last, nth, target = (page_id, sha), -1, None
                nth += 1
                refers = None if page_id is None or target is None or (target == page_id and not nth) else target
                files.add(_record(page_id, url, html, _b32(sha), nth, refers))
        files.close()
        yield pa.RecordBatch.from_pylist([dict(zip(_FILES.names, f, strict=True)) for f in files.done], pa.schema(
            [("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
        ))

    return run


def write_archives(
    pages: DataFrame, uri: str, *, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0, ranges: int | None = None
) -> list[dict]:
    """Write the archives of ``pages`` under the folder ``uri`` and commit their manifest; returns its entries."""
    spark = pages.sparkSession
    ship(spark)
    fs, root = _store(uri)
    fs.create_dir(posixpath.join(root, "_temporary"), recursive=True)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("sha", F.sha1("html"))
    # payloads that occur more than once: their keepers are few and narrow
    keepers = (
        own.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy(F.col("sha").alias("seen"))
        .agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1 and target is not null")
        .select("seen", "target")
    )
    # payloads are shuffled once: which page to refer to travels as a row of its own to the same place
    refer = own.filter("page_id is not null").select("page_id", "sha").join(keepers, F.col("sha") == F.col("seen")).distinct()
    null = F.lit(None)
    laid = own.withColumn("target", null.cast("bigint")).unionByName(
        refer.select("page_id", null.cast("string").alias("url"), null.cast("binary").alias("html"), "sha", "target")
    )
    n = ranges or shuffle_width(spark)
    files = (
        laid.repartitionByRange(n, "page_id", "sha")
        .sortWithinPartitions("page_id", "sha", F.col("html").isNotNull(), "url")
        .mapInArrow(_write(uri, roll_bytes), _FILES)
        .collect()
    )
    entries = sorted((f.asDict() for f in files), key=lambda f: f["file"])
    temp = posixpath.join(root, "_temporary", f"manifest.{uuid.uuid4().hex}")
    with fs.open_output_stream(temp) as out:
        out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode())
    fs.move(temp, posixpath.join(root, "manifest.jsonl"))
    fs.delete_dir(posixpath.join(root, "_temporary"))
    return entries


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed, read block by block."""
    z, made = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        made.append(z.decompress(data))
        if z.eof:
            yield b"".join(made)
            data, z, made = z.unused_data or stream.read(1 << 20), zlib.decompressobj(31), []
        else:
            data = stream.read(1 << 20)
    if any(made):
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    if fields["WARC-Block-Digest"] != "sha1:" + _b32(hashlib.sha1(block).hexdigest()):
        raise ValueError("the block's digest is wrong")
    return fields, block


def _summary(raw: bytes) -> tuple:
    fields, block = parse_record(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload) != size or _b32(hashlib.sha1(payload).hexdigest()) != digest):
        raise ValueError("the payload's digest is wrong")
    page, refers = fields.get("WARC-X-Page-ID"), fields.get("WARC-X-Refers-To-Page-ID")
    return (page and int(page), size, digest, kind, refers and int(refers))


def _read(uri: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(_summary(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """Records of the archives a manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ship(spark)
    fs, root = _store(uri)
    with fs.open_input_stream(posixpath.join(root, "manifest.jsonl")) as f:
        names = [json.loads(line)["file"] for line in f.read().decode().splitlines()]
    if not names:
        return spark.createDataFrame([], _RECORDS)
    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(min(len(names), 10_000))
    return files.mapInArrow(_read(uri), _RECORDS)


def round_trip(pages: DataFrame, uri: str | None = None, **options) -> DataFrame:
    spark = pages.sparkSession
    uri = uri or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, uri, **options)
    return read_archives(spark, uri)
