"""Objects of their own names, written by the tasks that hold their contents.

Each task writes its objects under temporary names that carry its attempt, and hands on a row for each: path, temporary
name, size and digest. Spark commits these rows as a manifest, in which only attempts that ended well are. A second pass
over the manifest renames what it lists. Renaming again changes nothing, so a repeated task of either pass leaves neither
a second copy nor a half-written object, and what failed attempts left goes with the temporary folder.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import ir_json, ir_path, masked_objects, raw_path, shared_folder
from .tables import Store

#: Opens the store in a task: a file system and the root folder in it. The default takes the folder's URI.
Opened = Callable[[], tuple["pa.fs.FileSystem", str]]
TEMPORARY = "_temporary"
MANIFEST = "path string, temporary string, bytes bigint, contentSha256 string"


def opener(root: str) -> Opened:
    def open_() -> tuple[pa.fs.FileSystem, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)

    return open_


def raw_objects(files: DataFrame) -> DataFrame:
    """Of uploads (id, fileName, content)."""
    return files.select(raw_path(F.col("id"), F.col("fileName")).alias("path"), F.col("content").cast("binary").alias("content"))


def masked_bodies(docs: DataFrame) -> DataFrame:
    """Of documents that are ready; others have no object."""
    return masked_objects(docs).select("path", F.col("maskedContent").cast("binary").alias("content"))


def layout_objects(docs: DataFrame, version: int = 1) -> DataFrame:
    """Of documents with a layout (docId, fileName, schemaVersion, source, pages)."""
    named = docs.select("docId", ir_path(F.col("docId"), F.col("fileName"), version).alias("path"))
    return ir_json(docs).join(named, "docId").select("path", F.col("json").cast("binary").alias("content"))


def _safe(path: Column) -> Column:
    """Whether a path stays below its root."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.startswith(TEMPORARY) & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def written_objects(rows: DataFrame, root: str, open_: Opened | None = None) -> DataFrame:
    """Writes ``rows`` (path, content) below ``root`` and gives path, bytes and contentSha256 of each object.

    An object that is there already is replaced. Nothing is written if a path occurs twice or leaves the root;
    rows without content have no object. Contents are held one Arrow batch at a time.
    """
    open_, job = open_ or opener(root), uuid.uuid4().hex
    rows = rows.select("path", "content").where("content IS NOT NULL")
    spark = rows.sparkSession
    bad = rows.groupBy("path").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~F.coalesce(_safe(F.col("path")), F.lit(False))).first()
    if bad:
        raise ValueError(f"object path {bad['path']!r} " + ("occurs twice" if bad["n"] > 1 else "is not below the root"))
    folder = shared_folder(spark, "objects")
    rows.mapInArrow(_Writing(open_, f"{TEMPORARY}/{job}"), MANIFEST).write.parquet(folder)
    manifest = spark.read.schema(MANIFEST).parquet(folder)
    manifest.mapInArrow(_Renaming(open_), "path string").write.format("noop").mode("overwrite").save()
    Store(spark, root).delete(f"{TEMPORARY}/{job}")
    return manifest.drop("temporary")


class _Writing:
    def __init__(self, open_: Opened, folder: str):
        self.open, self.folder = open_, folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = self.open()
        own = TaskContext.get()
        here = f"{self.folder}/{own.stageId()}-{own.partitionId()}-{own.taskAttemptId()}"
        fs.create_dir(posixpath.join(root, here))
        n = 0
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, name = content.as_buffer(), f"{here}/{n}"
                n += 1
                with fs.open_output_stream(posixpath.join(root, name)) as f:
                    f.write(data)
                out.append((path, name, data.size, hashlib.sha256(data).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "temporary", "bytes", "contentSha256"])


class _Renaming:
    def __init__(self, open_: Opened):
        self.open = open_

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as kinds

        fs, root = self.open()
        for batch in batches:
            for path, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("path", "temporary", "bytes")), strict=True):
                old, new = posixpath.join(root, temporary), posixpath.join(root, path)
                fs.create_dir(posixpath.dirname(new), recursive=True)
                if fs.get_file_info(old).type == kinds.FileType.File:
                    fs.move(old, new)
                elif (there := fs.get_file_info(new)).type != kinds.FileType.File or there.size != size:
                    raise OSError(f"neither {temporary} nor a whole {path} is there")
            yield batch.select(["path"])
