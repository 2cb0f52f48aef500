"""Context packages: the safety gate, what goes in, what goes to a human, and the rendered text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import EXPORTABLE, blocked_for_ai, gate_rationale, gate_reason, inventory_eligible, needs_masker, source_label
from ..functions.text import is_blank, iso_millis, js_trim

MAX_INVENTORY = 1000
#: Fixed values.
NO_BODY = "Body not available for Context Package export"
REVIEW = "Human review required"
INSTRUCTIONS = (
    "Use only the included AI-ready sources below.",
    "Do not use excluded documents.",
    "Do not infer missing operational rules.",
    "If required information is missing, ask the human owner.",
)
#: Columns of documents that may be long.
BODIES = ("aiSafeContent", "text", "content", "pages")
ROW = ("bucket", "docId", "fileName", "reason", "status", "sourceType", "sensitivity", "aiSafeViaMasking", "aiSafeContent")


def top_inventory(docs: DataFrame, limit: int = 100, eligible: Column | None = None) -> DataFrame:
    """The ``limit`` last updated documents, then those of them that are eligible: the limit comes first."""
    if not 1 <= limit <= MAX_INVENTORY:
        raise ValueError(f"limit must lie between 1 and {MAX_INVENTORY}")
    top = docs.orderBy(F.desc("updatedAt"), "id").limit(limit)
    return top if eligible is None else top.where(eligible)


def inventory_rows(docs: DataFrame) -> DataFrame:
    """Stored documents as inventory rows; those that are not at their end, or lack a label, their curator's or masker's block, have none.

    Times become ISO text, the masker's block also gives its evaluation, and maskingPending stays only where it is true.
    """
    has = set(docs.columns)
    col = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    masker = col("masker", "struct<residualRisk:struct<detected:boolean,reasons:array<string>>,recommendedSensitivity:string,rationale:string>")
    labels = [col(c) for c in ("documentType", "businessDomain", "sensitivity", "freshness", "isAuthoritativeCandidate", "aiUsePolicy", "sensitivitySource", "curator")]
    ends = docs.where(inventory_eligible(F.col("status"), labels, masker))
    evaluation = F.when(masker.isNotNull(), F.struct(masker["residualRisk"].alias("residualRisk"), masker["recommendedSensitivity"].alias("recommendedSensitivity"), masker["rationale"].alias("rationale")))
    external = col("externalSource", "struct<fileId:string,webViewLink:string>")
    return ends.select(
        "id", "fileName", F.col("storagePath").alias("sourcePath"), "storagePath", col("aiSafeStoragePath").alias("aiSafeStoragePath"), "status", iso_millis(F.col("createdAt").cast("timestamp")).alias("createdAt"), iso_millis(F.col("updatedAt").cast("timestamp")).alias("updatedAt"),
        "documentType", "businessDomain", "sensitivity", "freshness", "isAuthoritativeCandidate", "aiUsePolicy", F.col("curator.rationale").alias("rationale"), "sensitivitySource", col("originalCuratorSensitivity").alias("originalCuratorSensitivity"),
        col("sensitivityReason").alias("sensitivityReason"), "curator", masker.alias("masker"), evaluation.alias("maskerEvaluation"), "sourceKind", external["fileId"].alias("externalSourceFileId"), external["webViewLink"].alias("externalSourceWebViewLink"),
        F.when(col("maskingPending", "boolean"), True).alias("maskingPending"),
    )


def with_chunks(inventory: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the inventory's documents. An inventory is a top-k of a bounded k, so it is broadcast, but for its bodies."""
    parent = F.broadcast(inventory.select(F.col("id").alias("docId"), F.struct(*[c for c in inventory.columns if c not in BODIES]).alias("parent")))
    return chunks.join(parent, "docId")


def gated(chunks: DataFrame, cross_customer: Column | None = None) -> DataFrame:
    """``chunks`` with gateReason and gateRationale, null for those that pass."""
    masked = F.col("maskedText") if "maskedText" in chunks.columns else F.lit(None).cast("string")
    got = chunks.withColumn("gateReason", gate_reason(F.col("sensitivity"), F.col("aiUsePolicy"), masked, cross_customer))
    return got.withColumn("gateRationale", gate_rationale(F.col("gateReason"), F.col("sensitivity"), F.col("aiUsePolicy")))


def _row(bucket, **columns: Column) -> list[Column]:
    kinds = {"aiSafeViaMasking": "boolean"}
    given = {"bucket": F.lit(bucket) if isinstance(bucket, str) else bucket} | columns
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ROW]


def document_package(docs: DataFrame, placeholders: bool = False) -> DataFrame:
    """Rows of a package made of documents alone (inventory rows with aiSafeContent, contextPackageBodyLoadError, evaluated).

    The first reason that holds sends a document to a human; what is left is included, but nothing Restricted.
    """
    body, label = js_trim(F.coalesce("aiSafeContent", F.lit(""))), F.col("status")
    has = body != ""
    masked_body = (F.col("sensitivity") == "Confidential") & (F.col("aiUsePolicy") == "requires_masking")
    steps = [
        (blocked_for_ai(F.col("sensitivity"), F.col("aiUsePolicy")), F.coalesce("sensitivityReason", F.lit("Restricted after Masker residual risk — not for downstream AI")), F.lit("Restricted / human review only")),
        (~label.isin(*EXPORTABLE), F.concat(F.lit("Document status "), label, F.lit(" is not ready for Context Package export")), label),
        (needs_masker(F.col("aiUsePolicy"), F.col("evaluated")), F.lit("Masker evaluation required before AI inclusion"), F.lit("Pending masking review")),
        (F.col("contextPackageBodyLoadError").isNotNull(), F.col("contextPackageBodyLoadError"), label),
        (((label == "ai_safe") | masked_body) & ~has, F.lit("Confidential — masking required / no AI-safe version available for export"), F.lit(REVIEW)),
        (~has & F.lit(not placeholders), F.lit(NO_BODY), F.lit(REVIEW)),
    ]
    reason, status = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, why, said in reversed(steps):
        reason, status = F.when(cond, why).otherwise(reason), F.when(cond, said).otherwise(status)
    got = docs.withColumns({"_why": reason, "_said": status})
    review = F.col("_why").isNotNull()
    stand_in = F.concat(F.lit("[AI-safe content placeholder — "), F.col("fileName"), F.lit("]"))
    rows = got.where(review | (F.col("sensitivity") != "Restricted")).select(*_row(
        F.when(review, "humanReview").otherwise("included"), docId=F.col("id"), fileName=F.col("fileName"), reason=F.coalesce("_why", "rationale"), status=F.col("_said"),
        sourceType=F.when(~review, F.col("documentType")), sensitivity=F.when(~review, F.col("sensitivity")), aiSafeViaMasking=F.when(~review, F.col("evaluated") & has), aiSafeContent=F.when(~review, F.when(has, body).otherwise(stand_in)),
    ))
    return rows


def chunk_package(docs: DataFrame, chunks: DataFrame, placeholders: bool = False) -> DataFrame:
    """Rows of a package made of chunks; documents without chunks come as documents.

    Chunks of blocked or restricted parents, and blocked or Restricted chunks, leave no trace; orphans and bodies
    that are not there go to a human.
    """
    bare = docs.join(chunks.select(F.col("docId").alias("id")).distinct(), "id", "left_anti")
    parent = docs.select(F.col("id").alias("docId"), *(F.col(c).alias(f"p_{c}") for c in ("fileName", "status", "rationale", "documentType")))
    met = chunks.join(parent, "docId", "left").where(F.col("p_status").isNull() | (~F.col("p_status").isin("blocked", "restricted") & (F.col("aiUsePolicy") != "blocked") & (F.col("sensitivity") != "Restricted")))
    orphan, masking = F.col("p_status").isNull(), F.col("aiUsePolicy") == "requires_masking"
    body = js_trim(F.when(masking, F.col("maskedText")).otherwise(F.col("text")))
    review = orphan | is_blank(body)
    why = F.when(orphan, F.concat(F.lit("Chunk parent document not found for docId="), F.col("docId"))).when(masking, "Chunk requires masking but maskedText is unavailable").otherwise("Chunk text content is empty or unavailable")
    rows = met.select(*_row(
        F.when(review, "humanReview").otherwise("included"), docId=F.col("docId"), fileName=F.when(orphan, F.col("id")).otherwise(source_label(F.col("p_fileName"), F.col("locator"))),
        reason=F.when(review, why).otherwise(F.col("p_rationale")), status=F.when(review, REVIEW), sourceType=F.when(~review, F.col("p_documentType")), sensitivity=F.when(~review, F.col("sensitivity")),
        aiSafeViaMasking=F.when(~review, masking), aiSafeContent=F.when(~review, body),
    ))
    return document_package(bare, placeholders).unionByName(rows)


def selection_package(joined: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of a package from a selection: ``joined`` (gated chunks with parent) and ``refs`` (docId, chunkId, verdict, rationale, reason).

    A reference to a chunk that did not pass the gate fails the query when it is read, as does an included chunk
    that needs masking and has no masked text.
    """
    safe = joined.where("gateReason IS NULL").withColumn("chunkId", F.col("id"))
    met = refs.join(safe, ["docId", "chunkId"], "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("unknown chunk reference "), "docId", F.lit("/"), "chunkId"))).otherwise(F.col("verdict"))
    masking, name = F.col("aiUsePolicy") == "requires_masking", source_label(F.col("parent.fileName"), F.col("locator"))
    missing = F.raise_error(F.concat(F.lit("Chunk "), "docId", F.lit("/"), "chunkId", F.lit(" requires masking but maskedText is unavailable. Safety gate should have excluded this chunk.")))
    body = F.when(masking & is_blank(F.col("maskedText")), missing).when(masking, js_trim(F.col("maskedText"))).otherwise(js_trim(F.col("text")))
    inc = known == "included"
    chosen = met.select(*_row(
        known, docId=F.col("docId"), fileName=name, reason=F.when(inc | F.col("reason").isNull(), F.when(inc, F.col("rationale")).otherwise(js_trim(F.col("rationale")))).otherwise(F.concat(js_trim(F.col("rationale")), F.lit(" ["), "reason", F.lit("]"))),
        sourceType=F.when(inc, F.col("parent.documentType")), sensitivity=F.when(inc, F.col("sensitivity")), aiSafeViaMasking=F.when(inc, masking), aiSafeContent=F.when(inc, body),
    ))
    held = joined.where("gateReason IS NOT NULL").select(*_row(
        "humanReview", docId=F.col("docId"), fileName=name, reason=F.concat(js_trim(F.col("gateRationale")), F.lit(" [safety: "), "gateReason", F.lit("]")), status=F.col("gateReason"),
    ))
    return chosen.unionByName(held)


#: Rows of references and allowed ones that one task compares, and messages that one row is turned into at once.
TASK_ROWS, AT_ONCE = 500_000, 4096


def reference_violations(refs: DataFrame, allowed: DataFrame, rows: int | None = None) -> DataFrame:
    """docId, chunkId, message of references that are not allowed, repeat one or are both included and excluded.

    Both sides are dealt once by their key, into so many parts that a part has some ``TASK_ROWS``, whatever the size of the
    input; ``rows`` is how many they have at most together, counted if it is not given.
    """
    key = ["docId", "chunkId"]
    rows = refs.count() + allowed.count() if rows is None else rows
    parts = max(refs.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    known = allowed.dropna(subset=key).select(*key, F.lit(None).cast("string").alias("verdict"), F.lit(0).cast("bigint").alias("n"))
    every = refs.select(*key, F.col("verdict").cast("string").alias("verdict"), F.lit(1).cast("bigint").alias("n")).unionByName(known).repartition(parts, *key)
    by = every.groupBy(*key, "verdict").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("ok"))
    per = by.groupBy(*key).agg(F.sum("n").alias("n"), F.max("ok").alias("ok"), F.max(F.col("n") > 1).alias("again"), F.max(F.col("verdict") == "included").alias("i"), F.max(F.col("verdict") == "excluded").alias("e"))
    said = lambda message, times: F.struct(F.lit(message).alias("message"), times.cast("int").alias("times"))
    # a message for each place of an unknown reference, however many there are
    unknown = F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {AT_ONCE}")), lambda k: said("unknown reference", F.least(F.lit(AT_ONCE), F.col("n") - k * AT_ONCE)))
    both, again = F.when(F.expr("i AND e"), said("included and excluded", F.lit(1))), F.when(F.col("again"), said("repeated reference", F.lit(1)))
    own = F.filter(F.array(both, again), lambda x: x.isNotNull())
    met = per.where("n > 0").select(*key, F.explode(F.when(F.col("ok"), own).otherwise(F.concat(own, unknown))).alias("x"))
    return met.select(*key, F.col("x.message").alias("message"), F.explode(F.expr("array_repeat(0, x.times)")).alias("_")).drop("_")


#: Reasons that only the safety gate may give.
GATE_REASONS = ("restricted_sensitivity", "masking_required_unavailable", "cross_customer_confidentiality")


def selection_issues(selected: DataFrame, parents: DataFrame | None = None, gate_reasons: tuple[str, ...] = GATE_REASONS) -> DataFrame:
    """What is wrong with selections, in the order in which a reader of each would meet it.

    ``selected`` has a row for each reference: selection (which answer it is in), side (included or excluded), index (its
    place there, from 0), docId, chunkId and reason. Rows of the result are selection, ordinal (from 1), path and message:
    first repeated references, by side and index, each naming the first place of its reference, then reasons that are not
    the selector's, then, with ``parents`` (docId, chunkId, parentDocId), parents of another document. Only references that
    occur twice in a selection meet each other, by their key.
    """
    key = ["selection", "docId", "chunkId"]
    rank = F.when(F.col("side") == "included", 0).otherwise(1)
    firsts = selected.groupBy(*key).agg(F.min(F.when(F.col("side") == "included", F.col("index"))).alias("_i"), F.min(F.when(F.col("side") == "excluded", F.col("index"))).alias("_e"), F.count("*").alias("_n")).where("_n > 1")
    met = selected.join(firsts.repartition(F.xxhash64(*key)), key)
    first = F.when(F.col("side") == "included", F.col("_i")).otherwise(F.col("_e"))
    again = F.when(F.col("index") > first, F.concat(F.lit("duplicate chunk ref (docId + chunkId) also at "), "side", F.lit("["), first.cast("string"), F.lit("]")))
    both = F.when((F.col("side") == "excluded") & F.col("_i").isNotNull(), F.lit("chunk ref must not appear in both included and excluded"))
    at = lambda field: F.concat("side", F.lit("."), F.col("index").cast("string"), F.lit(f".{field}"))
    said = F.filter(F.array(F.struct(F.lit(0).alias("k"), again.alias("m")), F.struct(F.lit(1).alias("k"), both.alias("m"))), lambda x: x["m"].isNotNull())
    issues = met.select("selection", rank.alias("a"), F.col("index").cast("bigint").alias("b"), at("chunkId").alias("path"), F.explode(said).alias("x")).select("selection", "a", "b", F.col("x.k").alias("c"), "path", F.col("x.m").alias("message"))
    wrong = selected.where((F.col("side") == "excluded") & F.col("reason").isin(*gate_reasons))
    issues = issues.unionByName(wrong.select("selection", F.lit(2).alias("a"), F.col("index").cast("bigint").alias("b"), F.lit(0).alias("c"), at("reason").alias("path"), F.concat(F.lit("Strategist must not emit safety_gate-origin reason: "), "reason").alias("message")))
    if parents is not None:
        other = selected.join(parents.where("parentDocId <> docId"), ["docId", "chunkId"])
        issues = issues.unionByName(other.select("selection", F.lit(3).alias("a"), (F.col("index") * 2 + rank).cast("bigint").alias("b"), F.lit(0).alias("c"), F.lit("parent.docId").alias("path"), F.lit("parent.docId must equal chunk.docId").alias("message")))
    place = F.row_number().over(Window.partitionBy("selection").orderBy("a", "b", "c", "path"))
    return issues.select("selection", place.cast("bigint").alias("ordinal"), "path", "message")


def first_issue(issues: DataFrame) -> DataFrame:
    """The issue that a reader of each selection meets first."""
    return issues.where("ordinal = 1").drop("ordinal")


def package_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("bucket") == b).alias(b) for b in ("included", "excluded", "humanReview")))


def audit_target(rows: DataFrame) -> DataFrame:
    """One docId: of the first included, else excluded, else reviewed row; a synthetic one if there is none."""
    rank = F.when(F.col("bucket") == "included", 0).when(F.col("bucket") == "excluded", 1).otherwise(2)
    return rows.agg(F.coalesce(F.min_by("docId", F.struct(rank, "docId")), F.lit("context-package")).alias("docId"))


def rendered(rows: DataFrame, purpose: str, generated_at: str, reviewed: int, missing: list[str] | None = None, questions: list[str] | None = None, order: str = "ord") -> DataFrame:
    """One row, markdown: the package's text. A package is a bounded selection, so its rows meet in one aggregate."""
    label = F.when(F.col("aiSafeViaMasking"), F.concat("sensitivity", F.lit(" (AI-safe via masking)"))).otherwise(F.col("sensitivity"))
    inc = F.concat(F.lit("- "), "fileName", F.lit("\n  - Reason: "), "reason", F.lit("\n  - Source type: "), "sourceType", F.lit("\n  - Sensitivity: "), label)
    status = F.when(F.col("bucket") == "humanReview", F.coalesce("status", F.lit("Restricted / human review only"))).otherwise(F.col("status"))
    exc = F.concat(F.lit("- "), "fileName", F.lit("\n  - Reason: "), "reason", F.coalesce(F.concat(F.lit("\n  - Status: "), status), F.lit("")))
    src = F.concat(F.lit("## Source: "), "fileName", F.lit("\n\n```text\n"), js_trim(F.col("aiSafeContent")), F.lit("\n```"))
    pick = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct((F.col("bucket") == "humanReview").alias("last"), F.col(order).alias("at"), c.alias("said"))))), lambda x: x["said"])
    is_in, bucket = F.col("bucket") == "included", F.col("bucket")
    got = rows.agg(F.count_if(is_in).alias("i"), F.count_if(bucket == "excluded").alias("e"), F.count_if(bucket == "humanReview").alias("h"), pick(is_in, inc).alias("inc"), pick(~is_in, exc).alias("exc"), pick(is_in, src).alias("src"))
    part = lambda c, none, by: F.when(F.size(c) == 0, none).otherwise(F.array_join(c, by))
    bullets = "\n".join(f"- {x}" for x in missing or []) or "- None"
    numbered = "\n".join(f"{k}. {x}" for k, x in enumerate(questions or [], 1)) or "1. No questions."
    text = F.concat(
        F.lit(f"# AI-Ready Context Package\n\n## Package Manifest\n\n- Purpose: {purpose}\n- Generated at: {generated_at}\n- Source documents reviewed: {reviewed}\n- Included documents: "), F.col("i").cast("string"),
        F.lit("\n- Excluded documents: "), F.col("e").cast("string"), F.lit("\n- Human review required: "), F.col("h").cast("string"),
        F.lit("\n\n## Instructions for Downstream AI\n\n" + "\n".join(INSTRUCTIONS) + "\n\n## Included Documents\n\n"), part("inc", "- None", "\n"), F.lit("\n\n## Excluded Documents\n\n"), part("exc", "- None", "\n"),
        F.lit(f"\n\n## Missing Knowledge\n\n{bullets}\n\n## Questions for Human Owner\n\n{numbered}\n\n---\n\n# Full AI-Ready Sources\n\n"), part("src", "No AI-ready sources were included.", "\n\n"), F.lit("\n"),
    )
    return got.select(text.alias("markdown"))


#: What a selection returns.
REFS = "docId string, chunkId string, verdict string, rationale string, reason string"


class EmptyInventory(ValueError):
    """There is no document to answer a purpose from."""


class NoChunks(ValueError):
    """The documents have no chunks."""


def purpose_query(docs: DataFrame, chunks: DataFrame, select: Callable[[DataFrame], DataFrame], limit: int = 100, eligible: Column | None = None, cross_customer: Column | None = None) -> DataFrame:
    """Rows of the package for a purpose: top of the inventory, its chunks, the gate, the injected selection.

    ``select`` takes the chunks that passed and returns refs (docId, chunkId, verdict, rationale, reason); it is not
    called if none passed. An inventory without documents, or documents without chunks, is an error at once: each
    look stops at the first row.
    """
    top = top_inventory(docs, limit, eligible)
    if top.isEmpty():
        raise EmptyInventory("the inventory has no document that can be used")
    joined = gated(with_chunks(top, chunks), cross_customer)
    if joined.isEmpty():
        raise NoChunks("the inventory's documents have no chunks")
    safe = joined.where("gateReason IS NULL")
    refs = docs.sparkSession.createDataFrame([], REFS) if safe.isEmpty() else select(safe)
    return selection_package(joined, refs)


def latest(rows: DataFrame, key: str, *by: Column) -> DataFrame:
    """The first row of each key in the order ``by``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("_n = 1").drop("_n")
