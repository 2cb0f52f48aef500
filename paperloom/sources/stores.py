"""Look-ups in stored tables, what is stored of documents, and tables of intermediate results.

The tables themselves, whose changes are whole commits, are in ``tables``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import one_of
from .tables import BucketedTable, Log, Snapshot, Store

__all__ = ["BucketedTable", "Log", "Snapshot", "Store"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a local session (tests, one machine) makes a temporary one and removes it at exit; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, as a table in a folder of its own under ``spark.checkpoint.dir``.

    What injected models gave is thus the same to all that read it, and a lost executor runs none of them again.
    """
    path = shared_folder(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def by_id(rows: DataFrame, value, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == value)


def by_file(docs: DataFrame, file_id: str) -> DataFrame:
    """The workspace document of a file, by the least id if there are several; ``n`` says how many."""
    return one_of(docs.where((F.col("externalSource.fileId") == file_id) & (F.col("sourceKind") == "google_workspace")).withColumn("fileId", F.col("externalSource.fileId")), "fileId")


def with_latest_eval(docs: DataFrame, evals: DataFrame) -> DataFrame:
    """Documents with latestConversionEvalId from evaluations (evalId, docId, createdAt)."""
    last = evals.groupBy(F.col("docId").alias("id")).agg(F.max_by("evalId", F.struct("createdAt", "evalId")).alias("_last"))
    return docs.join(last, "id", "left").withColumn("latestConversionEvalId", F.coalesce("_last", "latestConversionEvalId")).drop("_last")


def raw_path(doc_id: Column, safe_name: Column) -> Column:
    return F.concat(F.lit("raw/"), doc_id, F.lit("/"), safe_name)


def ir_path(doc_id: Column, safe_name: Column, version: int = 1) -> Column:
    return F.concat(raw_path(doc_id, safe_name), F.lit(f"/document-ir/v{version}.json"))


def masked_objects(docs: DataFrame) -> DataFrame:
    """What is stored of masked documents: only those that are ready."""
    return docs.where(F.col("decision") == "ai_safe_ready").select("id", F.concat(F.lit("masked/"), "id").alias("path"), "maskedContent", F.sha2(F.col("maskedContent").cast("binary"), 256).alias("contentSha256"), F.lit(1).alias("aiSafeSchemaVersion"), "provider")


def ir_json(docs: DataFrame) -> DataFrame:
    """docId and json, the layout as indented JSON with a line end."""
    return docs.select("docId", F.concat(F.to_json(F.struct("schemaVersion", "source", "pages"), {"pretty": "true"}), F.lit("\n")).alias("json"))


def read_ir(raw: DataFrame, schema: str) -> DataFrame:
    """``raw`` (json) with ir; a JSON that does not fit fails when it is read, a missing one is null."""
    ir = F.from_json("json", schema)
    bad = F.col("json").isNotNull() & (ir.isNull() | ir["pages"].isNull() | ir["schemaVersion"].isNull())
    return raw.withColumn("ir", ir).where(F.when(bad, F.raise_error(F.lit("document layout does not fit its schema")).cast("boolean")).otherwise(True))


def bodies(docs: DataFrame, objects: DataFrame) -> DataFrame:
    """Documents with aiSafeContent from ``objects`` (path, body); a path without object is a load error, not a failure."""
    met = docs.join(objects.select(F.col("path").alias("bodyPath"), "body"), "bodyPath", "left")
    lost = F.col("bodyPath").isNotNull() & F.col("body").isNull()
    return met.withColumn("aiSafeContent", F.col("body")).withColumn("contextPackageBodyLoadError", F.when(lost, "Context Package body could not be read from storage")).drop("body")


def audit_events(rows: DataFrame, action: str, now: Column, tail: Column) -> DataFrame:
    """Audit rows for ``rows`` (tenantId, actor, docId, result, details)."""
    from ..functions.text import iso_millis, sortable_id

    return rows.select(sortable_id(F.unix_millis(now), tail).alias("eventId"), iso_millis(now).alias("occurredAt"), "tenantId", "actor", F.lit(action).alias("action"), F.col("docId").alias("targetDocId"), "result", "details")
