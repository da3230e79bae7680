"""WARC archives: written by tasks into the shared folder, read back record by record.

An archive is a run of gzip members, one WARC record in each. The reader goes through the file once, with
incremental zlib decompression and a bounded buffer: it frames a record by its header block and its
content length, closes it at the end of its member, and verifies block and payload digests.

Each task attempt writes files with names of its own and reports them in a manifest; only the manifest
rows that Spark commits count, so a repeated or lost attempt leaves no trace in the result. Files are
opened through `pyarrow.fs`, hence in any store that it knows (local, HDFS, S3, GCS).

Defined results: null html is an empty payload; null urls and ids are written as absent fields and come
back as null; repeated rows of the smallest id of a payload are all responses. A record whose digest,
length or framing is wrong is reported with `valid` false, and a damaged member ends its archive with such
a row.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import slices, text_batches
from labelloom.session import stage_table, staging_path

#: Bytes of an archive after which a task begins the next one, and of one read.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 18
#: Bytes of payload below which an equal record is not worth a revisit.
REVISIT_BYTES = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime.datetime(2024, 1, 1).strftime("%Y-%m-%dT%H:%M:%SZ")
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "payload binary, valid boolean"
)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    # Spark's short form of local paths has one slash
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


def record_bytes(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One record: a response with its payload, or a revisit of record `first` with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "revisit" if first is not None else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Page-ID", page_id),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if first is not None else None),
        ("WARC-Refers-To-Page-ID", first),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes | None]:
    """The decompressed members of a gzip stream, one after the other; None for one that is damaged or cut short."""
    data = stream.read(read_bytes)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        try:
            while not unpack.eof:
                if not data:
                    data = stream.read(read_bytes)
                    if not data:
                        yield None
                        return
                parts.append(unpack.decompress(data))
                data = b""
        except zlib.error:
            yield None
            return
        yield b"".join(parts)
        data = unpack.unused_data or stream.read(read_bytes)


def parse_record(record: bytes | None) -> tuple:
    """One row of RECORD."""
    damaged = (None, None, None, None, None, None, None, False)
    if record is None:
        return damaged
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    try:
        size = int(fields["content-length"])
        page = fields.get("warc-page-id")
        first = fields.get("warc-refers-to-page-id")
        page, first = page if page is None else int(page), first if first is None else int(first)
        block, tail = rest[:size], rest[size:]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        valid = lines[0].startswith("WARC/1.") and bool(gap) and len(block) == size and tail == b"\r\n\r\n"
        valid &= fields["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
        if kind == "response":
            valid &= hashlib.sha256(payload).hexdigest() == digest and int(length[1]) == len(payload)
        return page, fields.get("warc-target-uri"), kind, first, int(length[1]), digest, payload, bool(valid)
    except (KeyError, ValueError, TypeError):
        return damaged


def write_archives(pages: DataFrame, folder: str, id_column="page_id", url_column="url", html_column="html") -> DataFrame:
    """Writes one record per row under `folder`; returns the staged manifest of the archives.

    The first record of a payload is found on digests alone: a grouped minimum (combined before the
    shuffle), then a join on the digest that adaptive execution may split where a payload is hot.
    """
    payload = F.coalesce(F.col(html_column).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.unhex("digest").alias("key"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .drop("n")
    )
    marked = (
        rows.withColumn("key", F.unhex("digest"))
        .join(firsts, "key", "left")
        .select("page_id", "url", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"), "payload")
    )

    def write(batches):
        store = None
        out = path = None
        records = size = 0
        done = []

        def close():
            out.close()
            done.append((path, records, size))

        for piece in slices(batches):
            for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if out is None:
                    name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    path = name
                    store, place = store_of(name)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out, records, size = store.open_output_stream(place, compression=None), 0, 0
                page_id, url, digest, first, body = row
                size += out.write(member(record_bytes(page_id, url, body, digest, first))) or 0
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    size = out.tell()
                    close()
                    out = None
        if out is not None:
            size = out.tell()
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["path", "records", "bytes"],
            )

    return stage_table(text_batches(marked).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives at `path`; an archive is read by one task, in one pass."""
    spark = manifest.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches):
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            if not payloads:
                columns[6] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for piece in batches:
            for path in piece.column(0).to_pylist():
                store, place = store_of(path)
                with store.open_input_stream(place, compression=None) as stream:
                    rows, held = [], 0
                    for record in members(stream):
                        rows.append(parse_record(record))
                        held += len(record or b"")
                        if len(rows) >= 512 or held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return manifest.select("path").repartition(width, "path").mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes `pages` to archives in the shared folder and returns what the reader finds in them."""
    manifest = write_archives(pages, staging_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"
    )
