"""Workspace imports and the first inventory's snapshot. Fetching from a provider is injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import drive_error, legacy_status, promoted
from ..functions.text import content_hash, js_trim, workspace_file_name
from ..schemas import SNAPSHOT

#: Fixed values.
FILE_ID = r"^[A-Za-z0-9_-]{20,}$"
SHEETS = "application/vnd.google-apps.spreadsheet"
DOCS = "application/vnd.google-apps.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


@dataclass(frozen=True)
class Adapter:
    """How one kind of workspace file is taken: its type, what it is exported as, and its content for the pipeline."""

    mime: str
    export_mime: str
    extension: str
    normalized: Callable[[Column], Column]


ADAPTERS = {
    "sheets": Adapter(SHEETS, XLSX, ".xlsx", lambda c: c),
    "docs": Adapter(DOCS, "text/markdown", ".md", lambda c: F.try_validate_utf8(c.cast("string"))),
}


def file_id(given: Column) -> Column:
    """Of an URL or a bare id; null if it is neither."""
    bare = js_trim(given)
    in_url = F.regexp_extract(bare, r"/(?:spreadsheets|document)/d/([A-Za-z0-9_-]{20,})", 1)
    return F.when(bare.rlike(FILE_ID), bare).when(in_url != "", in_url)


def imported(requests: DataFrame, kind: str, fetch: Callable[[DataFrame], DataFrame], most: int = 5 * 1024 * 1024) -> DataFrame:
    """``requests`` (url) with what ``fetch`` adds (http, name, mimeType, content, modifiedTime), fileName, contentSha256 and error."""
    a = ADAPTERS[kind]
    got = fetch(requests.withColumn("fileId", file_id(F.col("url"))))
    error = (
        F.when(F.col("fileId").isNull(), "invalid_file_id").when(F.coalesce(F.col("http"), F.lit(200)) >= 400, drive_error(F.col("http"))).when(F.col("mimeType") != a.mime, "unexpected_type")
        .when(F.octet_length("content") > most, "too_large").when(a.normalized(F.col("content")).isNull(), "unreadable")
    )
    return got.withColumns({"fileName": workspace_file_name(F.col("name"), a.extension), "contentSha256": content_hash(F.col("content")), "exportMimeType": F.lit(a.export_mime), "error": error})


def legacy_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of the first inventory, with ids by place, states and the masker's promotions."""
    return adapted(_entries(spark, path))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    kind = "array<struct<" + ",".join(_fields()) + ">>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("entries"))


def _fields() -> list[str]:
    flat, depth, out = " ".join(SNAPSHOT.split()), 0, [""]
    for ch in flat:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip().replace(" ", ":", 1) for x in out]


def adapted(raw: DataFrame) -> DataFrame:
    """``raw`` (entries) as inventory rows; an entry without a file name fails when it is read."""
    rows = raw.select(F.posexplode("entries").alias("k", "e"))
    name = F.when(js_trim(F.coalesce("e.fileName", F.lit(""))) == "", F.raise_error(F.concat(F.lit("snapshot entry "), F.col("k").cast("string"), F.lit(": fileName is empty")))).otherwise(F.col("e.fileName"))
    rec = F.col("e.maskerEvaluation.recommendedSensitivity")
    base = rows.select(
        F.concat(F.lit("w1-"), F.col("k").cast("string"), F.lit("-"), F.regexp_replace(name, r"[^\p{L}\p{N}]+", "-")).alias("id"), name.alias("fileName"), F.col("e.sourcePath").alias("sourcePath"), F.col("e.sourcePath").alias("storagePath"),
        legacy_status(rec, F.col("e.aiUsePolicy")).alias("status"), *(F.col(f"e.{c}").alias(c) for c in ("documentType", "businessDomain", "sensitivity", "freshness", "isAuthoritativeCandidate", "aiUsePolicy", "rationale", "maskerEvaluation")),
        F.lit("curator").alias("sensitivitySource"), F.lit(None).cast("string").alias("originalCuratorSensitivity"), F.lit(None).cast("string").alias("sensitivityReason"),
    )
    m = F.col("maskerEvaluation")
    return promoted(base, m["recommendedSensitivity"], m["rationale"], m["residualRisk"]["reasons"])
