"""From uploads to terminal documents, chunks and evaluations, as one batch over tables.

The classifier and the risk check are injected; each adds columns to a table. Rows that fail get status failed
and what went wrong, and do not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.policy import decision_of, policy_of, promoted, status_of_decision, status_of_policy
from ..functions.text import content_hash, safe_file_name
from ..operators.evaluation import evaluated, readiness
from ..sources.stores import raw_path, settled

Step = Callable[[DataFrame], DataFrame]


def initial(files: DataFrame, now: Column, source_kind: str = "upload", keep: tuple[str, ...] = ()) -> DataFrame:
    """First document rows of accepted files (id, fileName, contentType, content): no labels, status uploaded.

    Columns named in ``keep`` are carried along, so nothing has to be joined back.
    """
    blank = ("documentType", "businessDomain", "sensitivity", "freshness", "aiUsePolicy", "sensitivitySource", "originalCuratorSensitivity", "sensitivityReason", "aiSafeStoragePath", "latestConversionEvalId")
    return files.select(
        "id", safe_file_name(F.col("fileName")).alias("fileName"), "contentType", content_hash(F.col("content")).alias("contentSha256"), F.lit(source_kind).alias("sourceKind"),
        raw_path(F.col("id"), safe_file_name(F.col("fileName"))).alias("storagePath"), F.lit("uploaded").alias("status"), F.lit(2).alias("schemaVersion"), F.octet_length("content").cast("bigint").alias("byteSize"),
        now.alias("createdAt"), now.alias("updatedAt"), *(F.lit(None).cast("string").alias(c) for c in blank), F.lit(False).alias("maskingPending"), "content", *keep,
    )


def to_curating(docs: DataFrame, now: Column) -> DataFrame:
    move = F.col("status") == "uploaded"
    return docs.withColumns({"updatedAt": F.when(move, now).otherwise(F.col("updatedAt")), "status": F.when(move, "curating").otherwise(F.col("status"))})


def failed(docs: DataFrame, column: str, message: Column, now: Column) -> DataFrame:
    """Rows with a message become failed, with an error of that kind; messages are cut at 8000 characters."""
    bad = message.isNotNull()
    said = F.when(F.length(message) > 8000, F.concat(F.left(message, F.lit(8000)), F.lit("…"))).otherwise(message)
    old = F.col(column) if column in docs.columns else F.lit(None).cast("struct<message:string,occurredAt:timestamp>")
    return docs.withColumns({"status": F.when(bad, "failed").otherwise(F.col("status")), column: F.when(bad, F.struct(said.alias("message"), now.cast("timestamp").alias("occurredAt"))).otherwise(old)})


def curated(docs: DataFrame, curate: Step, now: Column) -> DataFrame:
    """``curate`` adds c_sensitivity, c_rationale and, if it fails on a row, c_error; labels and the next status follow."""
    got = curate(docs)
    policy = policy_of(F.col("c_sensitivity"))
    got = got.withColumns({
        "sensitivity": F.col("c_sensitivity"), "aiUsePolicy": policy, "sensitivitySource": F.lit("curator"), "status": F.coalesce(status_of_policy(policy), F.col("status")),
        "curator": F.struct(F.col("c_sensitivity").alias("sensitivity"), policy.alias("aiUsePolicy"), F.col("c_rationale").alias("rationale")), "rationale": F.col("c_rationale"),
    })
    error = F.col("c_error") if "c_error" in got.columns else F.lit(None).cast("string")
    error = F.coalesce(error, F.when(policy.isNull(), F.lit("curator gave no known sensitivity")))
    return failed(got, "curatorError", error, now).drop("c_sensitivity", "c_rationale", "c_error")


#: Labels that the masker's decision may change.
LABELS = ("sensitivity", "aiUsePolicy", "sensitivitySource", "sensitivityReason", "originalCuratorSensitivity")


def converted(docs: DataFrame, column: str = "error", *, now: Column) -> DataFrame:
    """Documents whose layout could not be read (``column`` says why) fail with a conversionError; others pass."""
    return failed(docs, "conversionError", F.col(column), now).drop(column)


def masked(docs: DataFrame, risk: Step, mask: Callable[[DataFrame, str], DataFrame] = masking.simple_rule, text: str = "text", now: Column | None = None) -> DataFrame:
    """Documents in masking get a masked body and a decision, and end ai_safe or restricted; others pass.

    Where ``risk`` adds m_error, rows that have one become failed with a maskerError and keep their labels.

    ``docs`` is written once before it is split, so a classifier that differs between runs neither loses nor repeats a row.
    """
    docs = settled(docs)
    due = F.coalesce(F.col("status") == "masking", F.lit(False))
    done = docs.where(due).withColumns({f"_{c}": F.col(c) for c in LABELS if c in docs.columns})
    done = risk(mask(done, text)).withColumn("decision", decision_of(F.col("recommendedSensitivity")))
    done = promoted(done, F.col("recommendedSensitivity"), F.col("riskRationale"), F.col("reasons"))
    ready = F.col("decision") == "ai_safe_ready"
    done = done.withColumns({
        "status": status_of_decision(F.col("decision")), "aiSafeStoragePath": F.when(ready, F.concat(F.lit("masked/"), "id")), "aiSafeContent": F.when(ready, F.col("maskedContent")),
        "masker": F.struct("decision", "provider", F.size("maskedSpans").alias("maskedSpansCount"), "ruleHits", F.col("contentSha256").alias("sourceContentHash")),
    })
    extra = ["maskedSpans", "maskedContent", "ruleHits", "provider", "detected", "reasons", "recommendedSensitivity", "riskRationale", "decision"]
    if "m_error" in done.columns:  # a row that the masker or the risk check failed on ends there, without a body or a decision
        bad = F.col("m_error").isNotNull()
        made = [c for c in ("aiSafeStoragePath", "aiSafeContent", "masker") if c in done.columns]
        done = done.withColumns({c: F.when(~bad, F.col(c)) for c in made})
        done = done.withColumns({c: F.when(bad, F.col(f"_{c}")).otherwise(F.col(c)) for c in LABELS if f"_{c}" in done.columns})
        done = failed(done, "maskerError", F.col("m_error"), now if now is not None else F.current_timestamp()).drop("m_error")
    rest = docs.where(~due)
    return rest.unionByName(done.drop(*extra, *(f"_{c}" for c in LABELS)), allowMissingColumns=True)


def health(chunks: DataFrame) -> DataFrame:
    """Evaluation of each document's chunks at the health stage."""
    return evaluated(readiness(chunks), "health")


def regenerated(files: DataFrame, store=None, mask: Callable[[DataFrame, str], DataFrame] = masking.simple_rule, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Masked chunks of files (docId, fileName, content, sensitivity, aiUsePolicy), and files that gave none.

    Without ``dry_run`` they replace those documents' chunks in ``store``.
    """
    from ..sources.files import extracted

    chunks, bad = extracted(files)
    done = masking.mask_chunks(chunks, mask)
    if store is not None and not dry_run:
        store.replace(done)
    return done, bad


def layout_lifecycle(docs: DataFrame, curate: Step, risk: Step, now: Column, now_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with pages (docId, id, text, pages, sourceSubtype, extractorInput) to their state, their chunks and evaluations.

    Chunks come of documents that end curated or ai_safe; those of the latter are masked one by one.
    """
    from ..operators.chunking import ir_chunks

    done = settled(text_lifecycle(docs, curate, risk, now))
    chunks = masking.mask_chunks(ir_chunks(done.where(F.col("status").isin("curated", "ai_safe")).select("docId", "sourceSubtype", "extractorInput", "sensitivity", "aiUsePolicy", "pages"), now_text))
    chunks = settled(chunks)
    return done, chunks, health(chunks)


def conversion_audit(evals: DataFrame, docs: DataFrame) -> DataFrame:
    """docId, result and details of the audit of each conversion: partial where the evaluation failed."""
    from ..functions.policy import audit_result

    met = evals.join(docs.select("docId", "sourceSubtype").distinct(), "docId", "left")
    return met.select("docId", audit_result(F.col("status")).alias("result"), F.map_from_arrays(F.array(F.lit("sourceSubtype"), F.lit("evalStatus")), F.array(F.coalesce("sourceSubtype", F.lit("")), "status")).alias("details"))


def text_lifecycle(docs: DataFrame, curate: Step, risk: Step, now: Column) -> DataFrame:
    """Initial rows with text to their terminal state."""
    return masked(curated(to_curating(docs, now), curate, now), risk, now=now)
