"""Joins that pair up, guard and compare: append-only inserts, replacements, imports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insertable(new: DataFrame, existing: DataFrame, key: str, parents: DataFrame | None = None, parent: str = "docId") -> DataFrame:
    """``new`` with error: a key that is there already or twice in ``new``, or a parent that is missing."""
    had = existing.select(key).distinct().withColumn("_had", F.lit(True))
    twice = new.groupBy(key).agg(F.count("*").alias("_times"))
    got = new.join(twice, key).join(had, key, "left")
    if parents is not None:
        got = got.join(parents.select(F.col("id").alias(parent)).distinct().withColumn("_parent", F.lit(True)), parent, "left")
    no_parent = F.lit(False) if parents is None else F.col("_parent").isNull()
    error = F.when(F.col("_had").isNotNull(), "already exists").when(F.col("_times") > 1, "repeated in the batch").when(no_parent, "parent not found")
    return got.withColumn("error", error).select(*new.columns, "error")


def stale(existing: DataFrame, new: DataFrame, doc: str = "docId", key: str = "id") -> DataFrame:
    """Rows of the documents in ``new`` that ``new`` does not have any more."""
    touched = existing.join(new.select(doc).distinct(), doc, "left_semi")
    return touched.join(new.select(doc, key).distinct(), [doc, key], "left_anti")


def replaced(existing: DataFrame, new: DataFrame, doc: str = "docId") -> DataFrame:
    """``existing`` with all rows of the documents in ``new`` replaced by those of ``new``."""
    return existing.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new, allowMissingColumns=True)


def one_of(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The row with the least ``order`` of each key, and how many there are."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("row"), F.count("*").alias("n")).select("row.*", "n")


def import_actions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``incoming`` (fileId, contentSha256) with action and existingId, by the stored workspace documents.

    The same content of a document whose result can be rebuilt is skipped (its metadata is renewed), other
    content overwrites, an unknown file is created.
    """
    stored = one_of(existing.where(F.col("sourceKind") == "google_workspace"), "fileId").select("fileId", F.col("id").alias("existingId"), F.col("contentSha256").alias("_sha"), F.col("rehydratable").alias("_whole"))
    met = incoming.join(stored, "fileId", "left")
    same = F.coalesce((F.col("_sha") == F.col("contentSha256")) & F.col("_whole"), F.lit(False))
    return met.withColumn("action", F.when(F.col("existingId").isNull(), "create").when(same, "skip").otherwise("overwrite")).drop("_sha", "_whole")


def paired(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, and for each column its two values and whether they differ; rows of one side only are there too."""
    a = left.select(key, *(F.col(c).alias(f"{c}_left") for c in columns))
    b = right.select(key, *(F.col(c).alias(f"{c}_right") for c in columns))
    met = a.join(b, key, "full_outer")
    return met.withColumns({f"{c}_differs": ~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")) for c in columns})


def comparison_report(pairs: DataFrame, key: str, columns: list[str], title: str) -> DataFrame:
    """One row, markdown: a table of pairs. A report covers a bounded set of fixtures."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(key).cast("string"), *(x for c in columns for x in (show(f"{c}_left"), show(f"{c}_right")))), F.lit(" |"))
    head = "| " + " | ".join([key, *(f"{c} {s}" for c in columns for s in ("A", "B"))]) + " |"
    rule = "| " + " | ".join(["---"] * (1 + 2 * len(columns))) + " |"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("x")))), lambda s: s["x"])
    return pairs.agg(F.concat(F.lit(f"# {title}\n\n{head}\n{rule}\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))


def with_subtype(evals: DataFrame, docs: DataFrame) -> DataFrame:
    """sourceSubtype of an evaluation, or else of its document."""
    known = docs.select(F.col("id").alias("docId"), F.col("sourceSubtype").alias("_subtype"))
    return evals.join(known, "docId", "left").withColumn("sourceSubtype", F.coalesce("sourceSubtype", "_subtype")).drop("_subtype")


def samples(evals: DataFrame, docs: DataFrame, subtype: str, valid: Column, limit: int | None = None) -> DataFrame:
    """Valid evaluations of a subtype; the first ``limit`` by id, then in order of time and id."""
    got = with_subtype(evals, docs).where((F.col("sourceSubtype") == subtype) & valid)
    if limit is not None:
        got = got.orderBy("evalId").limit(limit)
    return got.orderBy(F.coalesce(F.unix_millis(F.try_to_timestamp("createdAt")), F.lit(0)), "evalId")


def migrated(docs: DataFrame) -> DataFrame:
    """Version 1 rows become version 2: an upload, without an external source; others stay."""
    old = F.coalesce(F.col("schemaVersion") == 1, F.lit(False))
    return docs.withColumns({"sourceKind": F.when(old, F.lit("upload")).otherwise(F.col("sourceKind")), "schemaVersion": F.when(old, F.lit(2)).otherwise(F.col("schemaVersion"))})


def preview(docs: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many rows ``migrated`` would change, and the first ``n`` of them (a dry run)."""
    old = docs.where(F.col("schemaVersion") == 1)
    return old.agg(F.count("*").alias("candidates")), old.orderBy("id").limit(n).select("id")
