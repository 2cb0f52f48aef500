"""WARC archives from a table of pages, written by many tasks and committed as a whole.

Records are range-sorted by page id, so each task writes a contiguous range and file names follow the
order. A task rolls to its next file once the compressed size passes ``roll_bytes``. Headers, record ids
and digests are made from the row alone; a task that runs again writes the same bytes. Files are written
under temporary names of their attempt; what Spark accepts from a task is its list of files, and only those
listed are renamed, after which the manifest is written. Files of lost attempts are never listed and go
with the temporary folder. Payloads are gzip members, one to a record.

Of equal payloads the record with the smallest page id is a response, the others revisit it.

Edge cases: null html is an empty payload, null url an empty target; equal page ids with equal payloads are
one response and revisits of it; null page ids are responses, whatever their payload; payloads of any length
are one record; an empty table gives an empty manifest and no file; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, qualified, release, shared_dir, small_batches, table

ROLL_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f2c1f64-4a1d-5d0e-9f63-0d6a5d6a7b11")
FILES = "temporary string, path string, records bigint, bytes bigint, first_page bigint, last_page bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = record_id(page_id, digest) if refers_to is None else record_id(page_id, digest + "/revisit")
    fields = [
        ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit", fields, http)


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _writing(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        part, attempt = task.partitionId(), task.taskAttemptId()
        temporary = f"{base}/_temporary/{part:06}-{attempt}"
        done, out, seq, size, pages = [], None, 0, 0, []

        def close() -> tuple:
            out.close()
            name = f"pages-{part:06}-{seq:05}.warc.gz"
            return (f"{temporary}/{name}", f"{base}/{name}", len(pages), size, pages[0], pages[-1])

        last = marked = None
        for batch in bounded(batches, "html"):
            for page_id, digest, is_page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "is_page", "url", "html", "first")), strict=True):
                if not is_page:  # says of the pages of this id and payload that they revisit another
                    marked = (page_id, digest, first)
                    continue
                first = marked[2] if marked and marked[:2] == (page_id, digest) else None
                payload = (html or "").encode()
                refers = first if first is not None and page_id is not None and first != page_id else None
                if page_id is not None and refers is None and (page_id, payload) == last:
                    refers = page_id
                last = (page_id, payload)
                if out is None:
                    store.create_dir(temporary, recursive=True)
                    name = f"pages-{part:06}-{seq:05}.warc.gz"
                    out, size, pages = store.open_output_stream(f"{temporary}/{name}", compression=None), 0, []
                    info = b"software: paperloom\r\nformat: WARC File Format 1.1\r\n"
                    data = _member(_record("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                    out.write(data)
                    size += len(data)
                data = _member(page_record(page_id, url or "", payload, refers))
                out.write(data)
                size += len(data)
                pages.append(page_id)
                if size >= roll_bytes:
                    done.append(close())
                    out, seq = None, seq + 1
        if out is not None:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.string()] * 2 + [pa.int64()] * 4, strict=True)], [c.split()[0] for c in FILES.split(", ")])

    return run


def _committing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for old, new in zip(batch.column("temporary").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    store.move(old, new)
                except OSError:  # an earlier attempt of this task has moved it
                    if store.get_file_info(new).type != fs.FileType.File:
                        raise
            yield batch.drop_columns(["temporary"])

    return run


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder`` (a URI all executors reach); its manifest, a row for each file."""
    spark = pages.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    firsts = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only ids and digests meet the first pages; payloads move once, and marks of revisits are sorted in before them
    # first pages are dealt out otherwise than their aggregation left them, so the join shuffles both sides and can split a hot digest
    firsts = firsts.repartition(F.xxhash64("digest", F.lit(1)))
    marks = pages.select("page_id", "digest").join(firsts, "digest").where(F.col("page_id") > F.col("first")).distinct()
    both = pages.withColumn("is_page", F.lit(True)).unionByName(marks.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    near = both.repartitionByRange(shards, "page_id", "digest").sortWithinPartitions("page_id", "digest", "is_page", "url")
    few = 1 + shards // 64  # lists have a row for each archive, so a few files hold them
    near.mapInArrow(_writing(folder, roll_bytes), FILES).repartition(few).write.parquet(f"{folder}/_listed")
    listed = spark.read.parquet(f"{folder}/_listed")
    listed.repartition(shards, "path").mapInArrow(_committing(folder), FILES.split(", ", 1)[1]).repartition(few).write.json(f"{folder}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for gone in ("_temporary", "_listed"):
        store.delete(path(f"{folder}/{gone}"), True)
    return spark.read.schema(FILES.split(", ", 1)[1]).json(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Each gzip member, decompressed; one is held at a time."""
    z, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the last member is cut off")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or "sha1:" + base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def _reading(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        fields, block = parsed(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and (len(payload) != n or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its header says")
                        page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(refers) if refers else None, n, digest, payload if whole and payloads else None))
                        held += len(payload) * payloads
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)
        release()

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the manifest's files; digests and lengths are checked on the way."""
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(shards, "path").mapInArrow(_reading(folder, payloads), RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, shared_dir(spark))
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
