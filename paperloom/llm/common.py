"""What the operators share: tables, Arrow batch sizes, the shared folder, bounded helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_ROWS, release, small_batches  # noqa: F401

#: Text bytes that a worker takes from a batch at once; one text may be longer.
BATCH_BYTES = 1 << 23
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Where none is set, a local session (tests, one machine) makes a temporary one and removes it at exit; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with the scheme that the cluster's default file system gives it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, lost executors lose nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each row, null as empty, without making Python strings."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices with rows, of at most ``BATCH_BYTES`` of ``column`` or one row; at the end, memory that this worker no longer needs goes back to the system."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end
    release()


def rows_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """``bounded`` batches with their texts."""
    for batch in bounded(batches, column):
        yield batch, texts_of(batch, column)


def sliced(text: bytes, at: re.Pattern[bytes] = SPACE) -> Iterator[bytes]:
    """The text in slices of about ``SLICE`` bytes that end where ``at`` matches."""
    start = 0
    while start < len(text):
        cut = at.search(text, start + SLICE)
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


def hash_bits(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of the top ``bits`` bits of a column of 64-bit hashes; the driver gets a row for each 64 bits at most."""
    top = f"shiftrightunsigned({column}, {64 - bits})"
    rows = hashes.groupBy(F.expr(f"shiftright({top}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({top} & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("set").to_numpy()
    return out.view(np.uint64)


def has_bit(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether the bit that the top ``bits`` bits of a hash name is set."""
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def plus(batch: pa.RecordBatch, drop: Iterable[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` without ``drop`` and with new columns at its end; a clashing old column gives way."""
    gone = {n.lower() for n in (*drop, *columns)}
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n.lower() not in gone}
    return pa.RecordBatch.from_pydict(kept | columns)


def schema_plus(df: DataFrame, drop: Iterable[str], columns: str | list[str]) -> str:
    """DDL of ``df`` without ``drop``, then ``columns`` (each a name and a type; one string only of plain types), matching ``plus``."""
    new = [c.strip() for c in (columns.split(",") if isinstance(columns, str) else columns)]
    gone = {n.lower() for n in (*drop, *(c.split()[0] for c in new if " " in c))}
    old = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() not in gone]
    return ", ".join(old + new)
