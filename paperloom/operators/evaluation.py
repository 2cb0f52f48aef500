"""Conversion quality: measures of six axes, their status at each stage, and the overall status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.invariants import MAX_CHUNK_BYTES
from ..functions.text import js_trim, semantic_key, utf16_length

#: Fixed values.
STAGES = {
    "health": ("schema_validity", "context_package_readiness"),
    "heuristic": ("schema_validity", "context_package_readiness", "coverage", "locator_quality", "safety_readiness"),
    "golden": ("schema_validity", "context_package_readiness", "coverage", "locator_quality", "safety_readiness", "semantic_retention"),
}
AXES = ("schemaValidity", "safetyReadiness", "coverage", "locatorQuality", "semanticRetention", "contextPackageReadiness")
LOW_DENSITY, COVERAGE_PASS, COVERAGE_WARN, BOUNDARY = 50, 1.0, 0.75, 40
GOLDEN_ONLY = ("locatorAccuracy", "keyFieldRecall", "piiDetectionRecall")


def readiness(chunks: DataFrame, payload_bytes: Column | None = None, most: int = MAX_CHUNK_BYTES) -> DataFrame:
    """docId, chunkCount, averageChunkLength, emptyChunks, oversizedChunks; by default only the text counts as payload."""
    size = F.octet_length(F.to_json(F.struct("text"))) if payload_bytes is None else payload_bytes
    return chunks.groupBy("docId").agg(
        F.count("*").alias("chunkCount"), F.avg(utf16_length(F.col("text"))).alias("averageChunkLength"),
        F.count_if(js_trim(F.col("text")) == "").alias("emptyChunks"), F.count_if(size > most).alias("oversizedChunks"),
    )


def coverage(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """docId, pageCoverage, tableCandidates, textDensityWarnings, hasPageLocators, hasTableLocators.

    ``blocks``: docId, pageNumber, pageOrd, kind, text, locator; ``pages``: docId, pageNumber, pageOrd, sourceSubtype.
    """
    per = blocks.groupBy("docId", "pageOrd").agg(
        F.count("*").alias("n"), F.sum(utf16_length(js_trim(F.col("text")))).alias("chars"), F.count_if(F.col("kind") == "table").alias("tables"),
        F.max(F.col("locator.pageNumber").isNotNull()).alias("page_at"), F.max(F.col("locator.tableIndex").isNotNull()).alias("table_at"),
    )
    all_pages = pages.join(per, ["docId", "pageOrd"], "left").fillna(0, ["n", "chars", "tables"])
    head = F.concat(F.lit("page "), F.col("pageNumber").cast("string"))
    warn = (
        F.when((F.col("n") == 0) & (F.col("sourceSubtype") == "scan-pdf"), F.concat(head, F.lit(": zero OCR blocks (scan-pdf pageCoverage miss)")))
        .when(F.col("n") == 0, F.lit(None).cast("string"))
        .when(F.col("chars") == 0, F.concat(head, F.lit(": all blocks are empty after trim")))
        .when(F.col("chars") < LOW_DENSITY, F.concat(head, F.lit(": low text density ("), F.col("chars").cast("string"), F.lit(" chars across "), F.col("n").cast("string"), F.lit(f" block(s); threshold={LOW_DENSITY})")))
    )
    got = all_pages.withColumn("warn", warn).groupBy("docId").agg(
        F.count("*").alias("pages"), F.count_if(F.col("chars") > 0).alias("filled"), F.sum("tables").alias("tableCandidates"),
        F.array_sort(F.collect_list(F.when(F.col("warn").isNotNull(), F.struct("pageOrd", "warn")))).alias("w"),
        F.coalesce(F.max("page_at"), F.lit(False)).alias("hasPageLocators"), F.coalesce(F.max("table_at"), F.lit(False)).alias("hasTableLocators"),
    )
    last = F.when(F.col("filled") == 0, F.array(F.concat(F.lit("document has "), F.col("pages").cast("string"), F.lit(" page(s) but no page produced a non-empty block (pageCoverage=0)")))).otherwise(F.array().cast("array<string>"))
    return got.select("docId", (F.col("filled") / F.col("pages")).alias("pageCoverage"), "tableCandidates", F.concat(F.transform("w", lambda x: x["warn"]), last).alias("textDensityWarnings"), "hasPageLocators", "hasTableLocators")


def chunk_ranges(chunks: DataFrame, boundary: int = BOUNDARY) -> DataFrame:
    """start and end of each chunk (docId, ord, text) in its document's joined text."""
    before = Window.partitionBy("docId").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    n = utf16_length(F.col("text"))
    start = F.coalesce(F.sum(n + boundary).over(before), F.lit(0))
    return chunks.withColumn("start", start).withColumn("end", F.col("start") + n)


def ordinals(rows: DataFrame, key: str, *order: Column, name: str = "ordinal") -> DataFrame:
    """``rows`` with their place, from 1, among those of their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def maskability(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """docId, unmaskablePiiFindings, maskableChunkRate; a span counts as maskable if one chunk with a usable place holds it.

    The join is on the document; ranges of a document do not overlap, so a span meets one at most.
    """
    r, s = ranges.alias("r"), spans.alias("s")
    held = s.join(r, (F.col("s.docId") == F.col("r.docId")) & (F.col("s.start") >= F.col("r.start")) & (F.col("s.end") <= F.col("r.end")), "left")
    usable = F.col("r.ord").isNotNull() & (F.coalesce(F.col("r.structureType"), F.lit("")) != "imageText") & F.col("r.locator").isNotNull()
    found = held.groupBy(F.col("s.docId").alias("docId")).agg(F.count_if(~usable).alias("unmaskablePiiFindings"), F.count_distinct(F.when(usable, F.col("r.ord"))).alias("maskable"))
    total = ranges.groupBy("docId").agg(F.count("*").alias("chunks"))
    met = total.join(found, "docId", "left").fillna(0, ["unmaskablePiiFindings", "maskable"])
    return met.select("docId", "unmaskablePiiFindings", (F.col("maskable") / F.col("chunks")).alias("maskableChunkRate"))


def retention(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """docId, keyFieldRecall, missingExpectedFields for ``expected`` (docId, expectedFields) against chunks (docId, ord, text)."""
    corpus = chunks.groupBy("docId").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("c"))
    corpus = corpus.select("docId", semantic_key(F.array_join(F.transform("c", lambda x: x["text"]), "\n")).alias("corpus"))
    fields = expected.select("docId", F.posexplode_outer("expectedFields").alias("k", "field")).withColumn("key", semantic_key(F.col("field")))
    met = fields.join(corpus, "docId", "left").withColumn("missing", F.col("field").isNotNull() & (F.col("key") != "") & ~F.coalesce(F.contains("corpus", "key"), F.lit(False)))
    got = met.groupBy("docId").agg(F.count("field").alias("n"), F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("k", "field")))).alias("m"))
    recall = F.when(F.col("n") == 0, 1.0).otherwise((F.col("n") - F.size("m")) / F.col("n"))
    return got.select("docId", recall.alias("keyFieldRecall"), F.transform("m", lambda x: x["field"]).alias("missingExpectedFields"))


def axis_statuses(stage: str, subtype: Column | None = None) -> dict[str, Column]:
    """Status columns over passed, errors (array), chunkCount, emptyChunks, oversizedChunks, pageCoverage, hasPageLocators,
    hasTableLocators, unmaskablePiiFindings and maskableChunkRate."""
    measured = STAGES[stage]
    scan = F.lit(False) if subtype is None else F.coalesce(subtype == "scan-pdf", F.lit(False))
    ok = F.lit("pass")
    safety = F.when(F.col("unmaskablePiiFindings") > 0, F.when(scan, "warn").otherwise("fail")).when(F.col("maskableChunkRate") < 0, "warn").otherwise("pass")
    return {
        "schemaValidity": F.when(~F.col("passed"), "fail").when(F.size("errors") > 0, "warn").otherwise("pass"),
        "safetyReadiness": safety if "safety_readiness" in measured else ok,
        "coverage": F.when(F.col("pageCoverage") >= COVERAGE_PASS, "pass").when(F.col("pageCoverage") >= COVERAGE_WARN, "warn").otherwise("fail") if "coverage" in measured else ok,
        "locatorQuality": F.when(~F.col("hasPageLocators"), "fail").when(~F.col("hasTableLocators"), "warn").otherwise("pass") if "locator_quality" in measured else ok,
        "semanticRetention": ok,
        "contextPackageReadiness": F.when((F.col("oversizedChunks") > 0) | (F.col("emptyChunks") > 0), "fail").when(F.col("chunkCount") == 0, "warn").otherwise("pass"),
    }


def overall() -> tuple[Column, Column]:
    """Status and reasons over the columns of ``axis_statuses``: two axes block; failures of others only warn."""
    blocks = (("schema_validity", "schemaValidity"), ("safety_readiness", "safetyReadiness"))
    rest = (("context_package_readiness", "contextPackageReadiness"), ("coverage", "coverage"), ("locator_quality", "locatorQuality"))
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    fails = some([F.when(F.col(c) == "fail", f"{n}: fail") for n, c in blocks])
    warns = some([F.when(F.col(c) == "warn", f"{n}: warn") for n, c in blocks] + [F.when(F.col(c) == "fail", f"{n}: fail (downgraded to warn)") for n, c in rest])
    return F.when(F.size(fails) > 0, "fail").when(F.size(warns) > 0, "warn").otherwise("pass"), F.when(F.size(fails) > 0, fails).otherwise(warns)


def evaluated(measures: DataFrame, stage: str, subtype: Column | None = None) -> DataFrame:
    """``measures`` with the six statuses, status and reasons. At health, only what that stage measures need be there."""
    have = set(measures.columns)
    blank = {"pageCoverage": F.lit(0.0), "hasPageLocators": F.lit(False), "hasTableLocators": F.lit(False), "unmaskablePiiFindings": F.lit(0), "maskableChunkRate": F.lit(1.0), "passed": F.lit(True), "errors": F.array().cast("array<string>")}
    clash = [c for c in AXES if c in have]
    got = measures.drop(*clash).withColumns({c: v for c, v in blank.items() if c not in have}).withColumns(axis_statuses(stage, subtype))
    status, reasons = overall()
    return got.withColumns({"status": status, "reasons": reasons})


#: Subtypes that a stage measures, and what the safety axis has where nothing was inspected.
SUBTYPES = ("official-doc-pdf", "slide-pdf", "scan-pdf")
NOT_INSPECTED = {"unmaskablePiiFindings": 0, "maskableChunkRate": 1.0}


def run_stage(measures: DataFrame, stage: str, inspect: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Evaluations of documents (docId, sourceSubtype and what ``evaluated`` takes) at one stage.

    A subtype that no stage measures fails its query when it is read, as do measures of the golden stage at another. Only
    the heuristic and the golden stage have a safety axis. Without ``inspect``, which adds unmaskablePiiFindings and
    maskableChunkRate, it is a dry run, whatever the input has: no findings, and all chunks maskable.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    name = {"health": "health check", "heuristic": "heuristic", "golden": "golden check"}[stage]
    known = F.coalesce(F.col("sourceSubtype").isin(*SUBTYPES), F.lit(False))
    said = F.concat(F.lit(f'{name} runner supports subtypes {", ".join(SUBTYPES)} only: received "'), F.coalesce("sourceSubtype", F.lit("null")), F.lit('"'))
    got = measures.where(F.when(known, True).otherwise(F.raise_error(said).cast("boolean")))
    extra = [c for c in GOLDEN_ONLY if c in got.columns]
    if extra and stage != "golden":
        wrong = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in extra))
        got = got.where(F.when(wrong.isNull(), True).otherwise(F.raise_error(F.concat(wrong, F.lit(f" is measured at golden only, not at {stage}"))).cast("boolean")))
    safe = "safety_readiness" in STAGES[stage] and inspect is not None
    got = inspect(got) if safe else got.withColumns({c: F.lit(v) for c, v in NOT_INSPECTED.items()})
    return evaluated(got, stage, F.col("sourceSubtype"))


def shape_violation(stage: str) -> Column:
    """Golden-only measures that are there at another stage."""
    named = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in GOLDEN_ONLY] if stage != "golden" else [F.lit(None).cast("string")]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def status_summary(evals: DataFrame) -> DataFrame:
    """pass, warn, fail: how many of each, zeros included."""
    return evals.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))


def axis_summary(evals: DataFrame) -> DataFrame:
    """axis, pass, warn, fail for the three axes that heuristic reports show."""
    long = evals.select(F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), F.col(c).alias("s")) for n, c in (("coverage", "coverage"), ("locator_quality", "locatorQuality"), ("safety_readiness", "safetyReadiness"))))).alias("x")).select("x.*")
    return long.groupBy("axis").agg(*(F.count_if(F.col("s") == s).alias(s) for s in ("pass", "warn", "fail")))


def page_coverage_of_source(covered: Column, source_pages: Column) -> Column:
    return F.when(source_pages > 0, F.least(F.lit(1.0), covered / source_pages)).otherwise(0.0)


def field_candidates(chunks: DataFrame, least: int = 4, most: int = 12) -> DataFrame:
    """docId, field, place: the first ``most`` different texts of at least ``least`` characters, in order."""
    text = js_trim(F.col("text"))
    first = chunks.withColumn("field", text).where(utf16_length(F.col("field")) >= least).groupBy("docId", "field").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("docId").orderBy("ord"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("docId", "field", "place")
