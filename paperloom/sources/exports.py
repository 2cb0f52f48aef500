"""Ordered exports as shards of JSON lines: shards in the order of their names are the rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import settled
from .tables import Store

#: Rows of a range, about, and of a file at most.
SHARD_ROWS, FILE_ROWS = 100_000, 200_000


def text_lines(rows: DataFrame, path: str, line: str, *order: Column, shard_rows: int = SHARD_ROWS, file_rows: int = FILE_ROWS) -> int:
    """Writes a column of ``rows`` as lines of text in the order given, and gives their number.

    Ranges of the order go to tasks, each sorted; Spark names its files by range and, within one, by number. ``order``
    must tell all rows apart, or equal ones may come in any order.
    """
    rows = settled(rows)  # bounds of the ranges and rows come of the same values
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // shard_rows)), *order).sortWithinPartitions(*order)
    dealt.select(F.col(line).alias("value")).write.option("maxRecordsPerFile", file_rows).text(path)
    return n


def jsonl(rows: DataFrame, path: str, *order: Column, shard_rows: int = SHARD_ROWS, file_rows: int = FILE_ROWS) -> int:
    """Writes ``rows`` as JSON lines in the order given and gives their number. Null fields are written, as the export has them."""
    lines = rows.withColumn("_line", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    return text_lines(lines, path, "_line", *order, shard_rows=shard_rows, file_rows=file_rows)


def shards(spark, path: str) -> list[str]:
    """The files of an export, in order."""
    return sorted(f for f in Store(spark, path).below("") if f.rpartition("/")[2].startswith("part-"))


SAMPLES = "evalId string, docId string, revisionId string, stage string, createdAt string, sourceSubtype string, coverage struct<pageCoverage:double,textDensityWarningsLength:bigint,tableCandidates:bigint>, locatorQuality struct<hasPageLocators:boolean,hasTableLocators:boolean>, contextPackageReadiness struct<oversizedChunks:bigint>, safetyReadiness struct<unmaskablePiiFindings:bigint,maskableChunkRate:double>"
RESULT = "coverage struct<pageCoverage:double,textDensityWarnings:array<string>,tableCandidates:bigint>, locatorQuality struct<hasPageLocators:boolean,hasTableLocators:boolean>, contextPackageReadiness struct<oversizedChunks:bigint>, safetyReadiness struct<unmaskablePiiFindings:bigint,maskableChunkRate:double>"


def evaluation_samples(evals: DataFrame, docs: DataFrame, subtype: str = "official-doc-pdf", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Export rows of stored evaluations (evalId, docId, revisionId, stage, createdAt, result as JSON, sourceSubtype), and (skippedBySubtype, skippedInvalid).

    An evaluation without a subtype has its document's (id, sourceSubtype). Those of another subtype are skipped, then those
    that do not parse. A limit takes the first by evalId, before anything is sorted by time; only evaluations up to the last
    that is taken count as skipped.
    """
    own = docs.select(F.col("id").alias("docId"), F.col("sourceSubtype").alias("_of")).dropDuplicates(["docId"])
    met = evals.join(own, "docId", "left").withColumn("sourceSubtype", F.coalesce("sourceSubtype", "_of")).withColumn("r", F.from_json("result", RESULT))
    fits = F.coalesce(F.col("sourceSubtype") == subtype, F.lit(False))
    r = F.col("r")
    whole = F.col("docId").isNotNull() & F.col("revisionId").isNotNull() & F.col("stage").isin("health", "heuristic", "golden") & r["coverage"]["pageCoverage"].isNotNull() & r["locatorQuality"]["hasPageLocators"].isNotNull() & r["contextPackageReadiness"]["oversizedChunks"].isNotNull() & r["safetyReadiness"].isNotNull()
    marked = met.withColumn("taken", fits & F.coalesce(whole, F.lit(False))).withColumn("fits", fits)
    if limit is not None:
        last = marked.where("taken").select("evalId").orderBy("evalId").limit(limit).agg(F.count("*").alias("n"), F.max("evalId").alias("last")).first()
        if last["n"] == limit:
            marked = marked.where(F.col("evalId") <= last["last"]) if limit else marked.limit(0)
    rows = marked.where("taken").select(
        "evalId", "docId", "revisionId", "stage", "createdAt", "sourceSubtype", F.struct(r["coverage"]["pageCoverage"].alias("pageCoverage"), F.coalesce(F.size(r["coverage"]["textDensityWarnings"]), F.lit(0)).cast("bigint").alias("textDensityWarningsLength"), r["coverage"]["tableCandidates"].alias("tableCandidates")).alias("coverage"),
        r["locatorQuality"].alias("locatorQuality"), r["contextPackageReadiness"].alias("contextPackageReadiness"), r["safetyReadiness"].alias("safetyReadiness"),
    )
    return rows, marked.agg(F.count_if(~F.col("fits")).alias("skippedBySubtype"), F.count_if(F.col("fits") & ~F.col("taken")).alias("skippedInvalid"))


def sample_order() -> tuple[Column, Column]:
    """By time, missing or unreadable ones as the epoch, then by id."""
    return F.coalesce(F.try_to_timestamp("createdAt"), F.timestamp_seconds(F.lit(0))), F.col("evalId")
