"""Reports over fixtures and runs: rates, counts of blocks and findings, checks of expectations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim
from .chunking import STRUCTURE
from .evaluation import axis_summary, status_summary


def pass_rate(runs: DataFrame) -> DataFrame:
    """total, passed and rate (0 for no runs) over a boolean column ``passed``."""
    return runs.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("passed") / F.col("total")))


def block_counts(pages: Column) -> Column:
    """blocks and tables of a layout."""
    blocks = F.flatten(F.transform(pages, lambda p: p["blocks"]))
    return F.struct(F.size(blocks).cast("bigint").alias("blocks"), F.size(F.filter(blocks, lambda b: b["kind"] == "table")).cast("bigint").alias("tables"))


def finding_split(findings: Column) -> Column:
    """total, maskable, unmaskable and whether all are unmaskable (never for none)."""
    bad = F.size(F.filter(findings, lambda f: f["maskability"] == "unmaskable"))
    n = F.size(findings)
    return F.struct(n.cast("bigint").alias("total"), (n - bad).cast("bigint").alias("maskable"), bad.cast("bigint").alias("unmaskable"), ((n > 0) & (n == bad)).alias("all_unmaskable"))


def non_empty_rate(chunks: DataFrame) -> DataFrame:
    """docId and the share of its chunks that hold visible text."""
    return chunks.groupBy("docId").agg(F.avg((js_trim(F.coalesce("text", F.lit(""))) != "").cast("double")).alias("maskableChunkRate"))


def slide_measures(pages: Column, threshold: int = 20) -> Column:
    """pageCoverage, textDensityWarnings, tableCandidates and hasTableLocators (all tables have both indices, and there is one) of slides."""
    chars = lambda p: F.aggregate(F.transform(p["blocks"], lambda b: F.length(js_trim(b["text"]))), F.lit(0), lambda a, x: a + x)
    tables = F.filter(F.flatten(F.transform(pages, lambda p: p["blocks"])), lambda b: b["kind"] == "table")
    thin = F.transform(F.filter(pages, lambda p: chars(p) < threshold), lambda p: F.concat(F.lit("slide "), p["pageNumber"].cast("string"), F.lit(" has low extracted text density")))
    placed = F.forall(tables, lambda b: b["locator"]["tableIndex"].isNotNull() & b["locator"]["rowIndex"].isNotNull())
    return F.struct(
        F.when(F.size(pages) == 0, 0.0).otherwise(F.size(F.filter(pages, lambda p: chars(p) > 0)) / F.size(pages)).alias("pageCoverage"), thin.alias("textDensityWarnings"),
        F.size(tables).cast("bigint").alias("tableCandidates"), ((F.size(tables) > 0) & F.coalesce(placed, F.lit(False))).alias("hasTableLocators"),
    )


def chunk_drafts(blocks: DataFrame) -> DataFrame:
    """Drafts of chunks from ``ir_blocks``: what a locator has no place for stays in metadata."""
    level = F.when(F.col("kind") == "heading", F.coalesce(F.try_element_at("metadata", F.lit("headingLevel")), F.lit("1")))
    box = F.col("locator.bbox")
    more = F.map_filter(F.create_map(F.lit("headingLevel"), level, F.lit("bbox"), F.when(box.isNotNull(), F.to_json(box))), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("headingLevel", "bbox"))
    structure = F.create_map(*(F.lit(x) for kv in STRUCTURE.items() for x in kv))[F.col("kind")]
    at = F.col("locator")
    para = F.when(at["tableIndex"].isNotNull() & at["rowIndex"].isNotNull(), F.concat(F.lit("table-"), at["tableIndex"].cast("string"), F.lit("-row-"), at["rowIndex"].cast("string"))).otherwise(F.col("blockId"))
    got = blocks.withColumns({"structureType": structure, "page": F.col("pageNumber"), "paragraphId": para, "meta": F.map_concat(kept, more)}).where(F.col("structureType").isNotNull())
    return got.withColumn("warning", F.when(box.isNotNull(), "bbox stored in metadata; locator uses pdf page + paragraphId only"))


def expectations(fixtures: DataFrame, expected: DataFrame) -> DataFrame:
    """Fixtures (documentId, expectedId) with expectedFields; a mismatch of ids or missing fields fails when it is read."""
    met = fixtures.join(expected.select(F.col("documentId").alias("_id"), "expectedFields"), F.col("expectedId") == F.col("_id"), "left")
    said = F.concat("documentId", F.lit('.expected.json documentId must be "'), "documentId", F.lit('", got "'), F.coalesce("expectedId", F.lit("null")), F.lit('"'))
    bad = F.when(~F.col("documentId").eqNullSafe(F.col("_id")), said).when(F.col("expectedFields").isNull(), F.concat("documentId", F.lit(".expected.json expectedFields must be an array")))
    return met.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).drop("_id")


def schema_errors(chunks: DataFrame, broken: Column) -> DataFrame:
    """docId, ord and message: a row for each chunk (docId, ord) that breaks a rule, however many a document has."""
    said = F.concat(F.lit("chunk["), F.col("ord").cast("string"), F.lit("] invariant failed: "), F.array_join(F.transform(broken, lambda v: v["message"]), "; "))
    return chunks.where(F.size(broken) > 0).select("docId", "ord", said.alias("message"))


def schema_validity(chunks: DataFrame, broken: Column) -> DataFrame:
    """docId, passed, errors (how many) and firstError (by ``ord``) of chunks with what each breaks; ``schema_errors`` lists them."""
    bad = F.size(broken) > 0
    said = F.concat(F.lit("chunk["), F.col("ord").cast("string"), F.lit("] invariant failed: "), F.array_join(F.transform(broken, lambda v: v["message"]), "; "))
    got = chunks.groupBy("docId").agg(F.count_if(bad).alias("errors"), F.min(F.when(bad, F.struct("ord", said.alias("m")))).alias("first"))
    return got.select("docId", (F.col("errors") == 0).alias("passed"), "errors", F.col("first.m").alias("firstError"))


def validity_report(chunks: DataFrame, broken: Column) -> DataFrame:
    """``schema_validity`` of each document, then every one of its errors: a row with ord and message for each, in which the document's own columns but passed are null."""
    own = schema_validity(chunks, broken).select("*", F.lit(None).cast(chunks.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("message"))
    each = schema_errors(chunks, broken).withColumns({"passed": F.lit(False), "errors": F.lit(None).cast("bigint"), "firstError": F.lit(None).cast("string")})
    return own.unionByName(each)


def ci_report(evals: DataFrame, stage: str) -> DataFrame:
    """part, docId and line: one JSON document as lines in the order of part and docId, of any number of fixtures.

    Part 0 has the stage and the summary, part 1 a line for each fixture, part 2 the end with, at the heuristic stage, counts by
    axis. ``exports.text_lines`` writes them in order.
    """
    first = evals.agg(F.min("docId")).first()[0]  # the only line of a fixture without a comma
    none = F.lit(None).cast(evals.schema["docId"].dataType)
    head = status_summary(evals).select(F.lit(0).alias("part"), none.alias("docId"), F.concat(F.lit(f'{{"stage":"{stage}","summary":'), F.to_json(F.struct("pass", "warn", "fail")), F.lit(',"fixtures":[')).alias("line"))
    each = evals.select(F.lit(1).alias("part"), "docId", F.concat(F.when(F.col("docId") > F.lit(first), ",").otherwise(""), F.to_json(F.struct("docId", "status", "reasons"))).alias("line"))
    if stage == "heuristic":  # three axes
        axes = axis_summary(evals).agg(F.array_sort(F.collect_list(F.struct("axis", "pass", "warn", "fail"))).alias("a")).select(F.concat(F.lit('],"heuristicAxisSummary":'), F.to_json("a"), F.lit("}")).alias("line"))
    else:
        axes = evals.sparkSession.createDataFrame([("]}",)], "line string")
    return head.unionByName(each).unionByName(axes.select(F.lit(2).alias("part"), none.alias("docId"), "line"))


def paired_names(docs: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """``docs`` with maskedName, the masked file that belongs to a file by a fixed list."""
    known = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast("map<string,string>")
    return docs.withColumn("maskedName", F.try_element_at(known, F.col("fileName")))


def preview_lines(text: Column, n: int = 36) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def prompt_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with prompt: what a selection model is shown of each; bodies are cut at 1200 characters."""
    from ..functions.text import prompt_body

    p = F.col("parent")
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(c.cast("string"), F.lit("(null)")))
    parts = [
        F.lit("### chunk"), line("fileName", p["fileName"]), line("documentType", p["documentType"]), line("docId", F.col("docId")), line("chunkId", F.col("id")), line("locator", F.to_json("locator")),
        line("sensitivity", F.col("sensitivity")), line("aiUsePolicy", F.col("aiUsePolicy")), F.concat(F.lit("```text\n"), prompt_body(F.col("text"), F.col("maskedText")), F.lit("\n```")),
    ]
    return chunks.withColumn("prompt", F.concat_ws("\n", *parts))
