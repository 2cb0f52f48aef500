"""Declared invariants: each check gives an array of what a row breaks; ``violations`` makes rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import CHUNK_PARENTS, policy_of
from .text import canonical_locator, is_blank, source_hash

MAX_CHUNK_BYTES = 512_000


def _broken(rules: list[tuple[str, Column, object]]) -> Column:
    """Array of (path, message) for the rules whose condition is true."""
    made = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(path).alias("path"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for path, cond, m in rules]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def document_violations(d) -> Column:
    """Of a document row; ``d`` gives its columns by name (a DataFrame will do). Messages are fixed values."""
    status, policy = d["status"], d["curator"]["aiUsePolicy"]
    decision = d["masker"]["decision"]
    ready = (status == "ai_safe") & F.coalesce(decision == "ai_safe_ready", F.lit(False))
    from_masker = F.coalesce(d["sensitivitySource"] == "masker", F.lit(False))
    has = lambda c: d[c].isNotNull()
    drive = F.coalesce(d["externalSource"]["provider"] == "google_drive", F.lit(False))
    return _broken([
        ("aiSafeStoragePath", has("aiSafeStoragePath") != ready, "aiSafeStoragePath must exist only when status is ai_safe and masker.decision is ai_safe_ready."),
        ("sensitivitySource", from_masker & ~(has("originalCuratorSensitivity") & (d["sensitivity"] == "Restricted") & (d["aiUsePolicy"] == "blocked") & (status == "restricted")), "masker-sourced sensitivity must be restricted, blocked, and retain originalCuratorSensitivity."),
        ("originalCuratorSensitivity", has("originalCuratorSensitivity") & ~from_masker, "originalCuratorSensitivity is only set when sensitivitySource is masker."),
        ("curator", status.isin(*CHUNK_PARENTS) & ~has("curator"), "curator block is required for terminal status curated/blocked/ai_safe/restricted."),
        ("masker", status.isin("ai_safe", "restricted") & ~has("masker"), "masker block is required when status is ai_safe or restricted."),
        ("masker", has("masker") & ~F.coalesce(policy == "requires_masking", F.lit(False)), "masker block requires a curator block whose aiUsePolicy is requires_masking."),
        ("masker.sourceContentHash", has("masker") & ~d["masker"]["sourceContentHash"].eqNullSafe(d["contentSha256"]), "masker.sourceContentHash must match contentSha256."),
        ("status", (status == "curated") & ~F.coalesce((policy == "direct") | ((policy == "requires_masking") & d["maskingPending"]), F.lit(False)), "status curated requires aiUsePolicy=direct, or legacy requires_masking with maskingPending:true."),
        ("status", (status == "blocked") & ~F.coalesce(policy == "blocked", F.lit(False)), "status blocked is only for curator.aiUsePolicy blocked."),
        ("status", (status == "restricted") & ~(F.coalesce(decision == "restricted_promoted", F.lit(False)) & from_masker), "status restricted requires masker.decision restricted_promoted and sensitivitySource masker."),
        ("sensitivityReason", (status == "restricted") & is_blank(d["sensitivityReason"]), "status restricted requires non-empty sensitivityReason."),
        ("sourceKind", ~F.coalesce(d["sourceKind"].isin("upload", "google_workspace"), F.lit(False)), "sourceKind must be one of upload or google_workspace."),
        ("sourceKind", F.coalesce(d["sourceKind"] == "google_workspace", F.lit(False)) != drive, "sourceKind google_workspace requires externalSource provider google_drive, and upload requires externalSource null."),
    ])


def chunk_violations(c, parent_id: Column, parent_status: Column, extractor_input: Column, payload_bytes: Column, most: int = MAX_CHUNK_BYTES) -> Column:
    """Of a chunk row beside its parent's id and status and what its extractor read. Messages are fixed values."""
    wanted, hashed = policy_of(c["sensitivity"]), source_hash(canonical_locator(c["locator"]), extractor_input)
    return _broken([
        ("docId", ~parent_id.eqNullSafe(c["docId"]), "parentDocument.id must match chunk.docId for chunk parent binding."),
        ("parentDocument.status", ~F.coalesce(parent_status.isin(*CHUNK_PARENTS), F.lit(False)), "parentDocument.status must be one of curated, ai_safe, restricted, or blocked."),
        ("aiUsePolicy", ~c["aiUsePolicy"].eqNullSafe(wanted), F.concat(F.lit("When sensitivity is "), c["sensitivity"], F.lit(", aiUsePolicy must be "), wanted, F.lit("."))),
        ("maskedText", (c["aiUsePolicy"] == "requires_masking") & (F.coalesce(c["maskedText"], F.lit("")) == ""), "When aiUsePolicy is requires_masking, maskedText must be present and non-empty."),
        ("sensitivityReason", (c["sensitivitySource"] == "columnRule") & is_blank(c["sensitivityReason"]), "When sensitivitySource is columnRule, sensitivityReason must be non-empty."),
        ("sourceHash", ~c["sourceHash"].eqNullSafe(hashed), F.concat(F.lit("sourceHash must equal computeChunkSourceHash(extractorInput, locator); expected "), hashed, F.lit(", got "), F.coalesce(c["sourceHash"], F.lit("null")), F.lit("."))),
        ("bytes", payload_bytes > most, F.concat(F.lit(f"Estimated chunk Firestore payload must be <= {most} bytes; got "), payload_bytes.cast("string"), F.lit(". Split the source sheet or move chunk bodies out of inline Firestore storage."))),
    ])


def violations(rows: DataFrame, key: str, broken: Column) -> DataFrame:
    """key, path, message: one row for each broken rule."""
    return rows.select(key, F.explode(broken).alias("v")).select(key, "v.path", "v.message")


def asserted(rows: DataFrame, broken: Column, what: str) -> DataFrame:
    """``rows``, which fail when read if one breaks a rule (the throwing form)."""
    said = F.concat(F.lit(f"{what}: "), F.array_join(F.transform(broken, lambda v: v["message"]), "; "))
    return rows.where(F.when(F.size(broken) > 0, F.raise_error(said).cast("boolean")).otherwise(True))


def quarantined(rows: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules; rows that do not, with ``violations``."""
    marked = rows.withColumn("violations", broken)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
