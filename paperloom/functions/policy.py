"""Labels, states and decisions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

#: Fixed values, in order where order counts.
SENSITIVITIES = ("Public", "Internal", "Confidential", "Restricted")
POLICIES = ("direct", "requires_masking", "blocked")
STATUSES = ("uploaded", "curating", "masking", "curated", "blocked", "ai_safe", "restricted", "failed")
TERMINAL = ("curated", "blocked", "ai_safe", "restricted", "failed")
EXPORTABLE = ("curated", "ai_safe")
CHUNK_PARENTS = ("curated", "ai_safe", "restricted", "blocked")
INVENTORY = ("documentType", "businessDomain", "sensitivity", "freshness", "aiUsePolicy", "isAuthoritativeCandidate", "sensitivitySource", "curator")
GATE_REASONS = ("restricted_sensitivity", "masking_required_unavailable", "cross_customer_confidentiality")
VERTEX = ("gemini-vertex", "gemini-vertex-ocr")


def policy_of(sensitivity: Column) -> Column:
    return F.when(sensitivity.isin("Public", "Internal"), "direct").when(sensitivity == "Confidential", "requires_masking").when(sensitivity == "Restricted", "blocked")


def rank_of(sensitivity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SENSITIVITIES)), sensitivity) - 1


def status_of_policy(policy: Column) -> Column:
    return F.when(policy == "direct", "curated").when(policy == "blocked", "blocked").when(policy == "requires_masking", "masking")


def status_of_decision(decision: Column) -> Column:
    return F.when(decision == "ai_safe_ready", "ai_safe").otherwise("restricted")


def risk_consistent(detected: Column, recommended: Column, reasons: Column) -> Column:
    """Restricted is recommended exactly if a risk was detected, else Confidential; there are one to five reasons."""
    return F.coalesce((recommended == F.when(detected, "Restricted").otherwise("Confidential")) & F.size(reasons).between(1, 5), F.lit(False))


def label_violation(sensitivity: Column, policy: Column) -> Column:
    """What a classifier's labels break, if anything."""
    wanted = policy_of(sensitivity)
    said = F.concat(F.lit("sensitivity が "), sensitivity, F.lit(" のとき aiUsePolicy は "), wanted, F.lit(" である必要があります（実際: "), policy, F.lit("）"))
    return F.when(~policy.eqNullSafe(wanted), F.coalesce(said, F.lit("sensitivity is not known")))


def rehydratable(status: Column, curator: Column, masker: Column, masked_path: Column, reason: Column, original: Column) -> Column:
    """Whether a stored document still has all that its processing answered."""
    full = status.isin("curated", "blocked") | ((status == "ai_safe") & masker.isNotNull() & masked_path.isNotNull()) | ((status == "restricted") & masker.isNotNull() & reason.isNotNull() & original.isNotNull())
    return F.coalesce(curator.isNotNull() & full, F.lit(False))


def flag_choice(flags, tenant: Column, now: Column, order: tuple[str, ...] = ("pdf-conversion-subtype-3", "pdf-conversion-subtype-2", "pdf-conversion"), by: tuple[str, ...] = ()):
    """The one enabled flag of ``order``, or the code of what is wrong (none, or several): one row, or one for each ``by`` of ``flags``."""
    on = F.when(F.col("flagId").isin(*order) & flag_enabled(F.col("defaultEnabled"), F.col("enabledTenants"), F.col("expiresAt"), tenant, now), F.col("flagId"))
    got = flags.groupBy(*by).agg(F.count(on).alias("n"), F.min(on).alias("first"))
    return got.select(*by, F.when(F.col("n") == 1, F.col("first")).alias("flagId"), F.when(F.col("n") == 0, "not_enabled").when(F.col("n") > 1, "conflicting_flags").alias("code"))


def auth_context(tenant_header: Column, actor_header: Column, proxy_header: Column, local: bool = False) -> Column:
    """tenantId, email and provider of a request, by forwarded headers, else the proxy's, else (if allowed) a local one; null if none fits."""
    from .text import proxy_email, tenant_normalized, tenant_of_email

    made = lambda t, e, p: F.struct(t.alias("tenantId"), e.alias("email"), F.lit(p).alias("provider"))
    tenant, actor, email = F.nullif(tenant_normalized(tenant_header), F.lit("")), proxy_email(actor_header), proxy_email(proxy_header)
    forwarded = F.coalesce((tenant_header != "") & (actor_header != ""), F.lit(False))
    got = F.when(forwarded & tenant.isNotNull() & actor.isNotNull(), made(tenant, actor, "iap")).when(~forwarded & email.isNotNull(), made(tenant_of_email(email), email, "iap"))
    return got.when(~forwarded & email.isNull(), made(F.lit("local-dev"), F.lit("local-dev@localhost.local"), "local-dev")) if local else got


def decision_of(recommended: Column) -> Column:
    return F.when(recommended == "Restricted", "restricted_promoted").otherwise("ai_safe_ready")


def promotion_reason(rationale: Column, reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.concat(rationale, F.lit(" ("), F.array_join(reasons, "; "), F.lit(")"))).otherwise(rationale)


def promoted(df, recommended: Column, rationale: Column, reasons: Column):
    """Labels after the masker: Restricted where it is recommended; the curator's own label is kept once."""
    up = recommended == "Restricted"
    return df.withColumns({
        "originalCuratorSensitivity": F.when(up, F.coalesce(F.col("originalCuratorSensitivity"), F.col("sensitivity"))).otherwise(F.col("originalCuratorSensitivity")),
        "sensitivity": F.when(up, "Restricted").otherwise(F.col("sensitivity")),
        "aiUsePolicy": F.when(up, "blocked").otherwise(F.col("aiUsePolicy")),
        "sensitivitySource": F.when(up, "masker").otherwise(F.col("sensitivitySource")),
        "sensitivityReason": F.when(up, promotion_reason(rationale, reasons)).otherwise(F.col("sensitivityReason")),
    })


def was_promoted(source: Column, sensitivity: Column) -> Column:
    return F.coalesce((source == "masker") & (sensitivity == "Restricted"), F.lit(False))


def blocked_for_ai(sensitivity: Column, policy: Column) -> Column:
    return F.coalesce((sensitivity == "Restricted") | (policy == "blocked"), F.lit(False))


def needs_masker(policy: Column, evaluated: Column) -> Column:
    return F.coalesce(policy == "requires_masking", F.lit(False)) & ~evaluated


def inventory_eligible(status: Column, required: list[Column], masker: Column) -> Column:
    ok = status.isin(*TERMINAL)
    for c in required:
        ok = ok & c.isNotNull()
    return F.coalesce(ok & (~status.isin("ai_safe", "restricted") | masker.isNotNull()), F.lit(False))


def safe_for_export(status: Column, load_error: Column, sensitivity: Column, policy: Column, evaluated: Column, body: Column) -> Column:
    """Only rows with a body, a state that is exported and nothing that holds them back."""
    return F.coalesce(status.isin(*EXPORTABLE), F.lit(False)) & load_error.isNull() & ~blocked_for_ai(sensitivity, policy) & ~needs_masker(policy, evaluated) & ~is_blank(body)


def gate_reason(sensitivity: Column, policy: Column, masked: Column, cross_customer: Column | None = None) -> Column:
    """Why the safety gate holds a chunk back; null if it does not."""
    other = F.lit(False) if cross_customer is None else F.coalesce(cross_customer, F.lit(False))
    return (
        F.when((sensitivity == "Restricted") | (policy == "blocked"), GATE_REASONS[0])
        .when((policy == "requires_masking") & is_blank(masked), GATE_REASONS[1])
        .when(other, GATE_REASONS[2])
    )


def gate_rationale(reason: Column, sensitivity: Column, policy: Column) -> Column:
    #: Fixed values.
    return (
        F.when(reason == GATE_REASONS[0], F.concat(F.lit("safety gate: sensitivity="), sensitivity, F.lit(", aiUsePolicy="), policy))
        .when(reason == GATE_REASONS[1], "safety gate: aiUsePolicy=requires_masking だが maskedText が未生成")
        .when(reason == GATE_REASONS[2], "safety gate: 他顧客スコープの機密と判定")
    )


def flag_enabled(default: Column, tenants: Column, expires_at: Column, tenant: Column, now: Column) -> Column:
    """A missing or expired flag is off; a listed tenant has it on; else its default holds."""
    expired = F.coalesce(F.try_to_timestamp(expires_at.cast("string")) <= now, F.lit(False))
    return F.coalesce(F.when(expired, False).when(F.array_contains(tenants, tenant), True).otherwise(default), F.lit(False))


def body_path(status: Column, policy: Column, pending: Column, raw: Column, masked: Column) -> Column:
    """Where a document's exportable body lies; null if nowhere."""
    open_ = (status == "curated") & ~F.coalesce(pending, F.lit(False)) & (policy != "requires_masking")
    return F.when(status == "ai_safe", masked).when(open_, raw)


def legacy_status(recommended: Column, policy: Column) -> Column:
    """State of rows of the first inventory, which had none."""
    return (
        F.when(recommended == "Restricted", "restricted").when(recommended == "Confidential", "ai_safe")
        .when(policy == "blocked", "blocked").when(policy == "requires_masking", "masking").otherwise("curated")
    )


def import_kind(url: Column) -> Column:
    return F.when(url.rlike(r"docs\.google\.com/document/"), "docs").otherwise("sheets")


def newer(latest: Column, saved: Column) -> Column:
    """Later, if both are times; else merely different."""
    a, b = F.try_to_timestamp(latest), F.try_to_timestamp(saved)
    return F.when(a.isNotNull() & b.isNotNull(), a > b).otherwise(~latest.eqNullSafe(saved))


def freshness(found: Column, workspace: Column, http: Column, latest: Column, saved: Column) -> Column:
    """What a freshness check answers: fresh or stale, or why it cannot tell."""
    return (
        F.when(~found, "not_found").when(~workspace, "not_workspace").when(saved.isNull(), "saved_time_missing").when(http == 403, "drive_forbidden")
        .when(http == 404, "drive_not_found").when(http >= 400, "drive_error").when(latest.isNull(), "latest_time_missing").when(newer(latest, saved), "stale").otherwise("fresh")
    )


def inference_violation(subtype: Column, converter: Column, destination: Column) -> Column:
    """Which rule of the conversion audit a row breaks: a destination is needed exactly for slides and scans read by a hosted model."""
    needed = F.coalesce(subtype.isin("slide-pdf", "scan-pdf") & converter.isin(*VERTEX), F.lit(False))
    where = F.concat(F.lit(" for converterId="), converter, F.lit(" on sourceSubtype="), subtype)
    return F.when(needed & destination.isNull(), F.concat(F.lit("document.convert: inferenceDestination is required"), where)).when(
        ~needed & destination.isNotNull(), F.concat(F.lit("document.convert: inferenceDestination must not be set"), where)
    )


def unmaskable_violation(subtype: Column, converter: Column, result: Column, count: Column) -> Column:
    scan = F.coalesce((subtype == "scan-pdf") & (converter == "gemini-vertex-ocr"), F.lit(False))
    where = F.concat(F.lit(" for converterId="), converter, F.lit(" on sourceSubtype="), subtype)
    return F.when(scan & result.isin("success", "partial") & count.isNull(), F.concat(F.lit("document.convert: conversion.unmaskablePiiFindings.count is required"), where, F.lit(" with result="), result)).when(
        ~scan & count.isNotNull(), F.concat(F.lit("document.convert: conversion.unmaskablePiiFindings must not be set"), where)
    )


def audit_result(eval_status: Column) -> Column:
    return F.when(eval_status.isin("fail", "error"), "partial").otherwise("success")


def source_label(file_name: Column, locator: Column) -> Column:
    """The file, with sheet and range for spreadsheets."""
    return F.when(locator["kind"] == "spreadsheet", F.concat(file_name, F.lit(" (sheet="), locator["sheetName"], F.lit(", range="), locator["range"], F.lit(")"))).otherwise(file_name)


def drive_error(http: Column) -> Column:
    return F.when(http.isin(401, 403), "drive_forbidden").when(http == 404, "drive_not_found").when(http == 413, "too_large").when(http >= 500, "drive_unavailable").when(http >= 400, "drive_error")


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, rate_in: Column | None = None, rate_out: Column | None = None) -> Column:
    """US dollars for a call; null if a count or the model's rate is not known. Rates are per million tokens."""
    #: Model, rate in, rate out; the first that a model's name contains holds.
    rates = (("gemini-2.5-flash-lite", 0.1, 0.4), ("gemini-2.5-flash", 0.3, 2.5))
    known = lambda k: F.coalesce(*(F.when(model.contains(r[0]), F.lit(r[k])) for r in rates))
    first, second = (known(k) if given is None else F.coalesce(given, known(k)) for k, given in ((1, rate_in), (2, rate_out)))
    return tokens_in / 1_000_000 * first + tokens_out / 1_000_000 * second


def response(status: Column, masked_path: Column, masker: Column, reason: Column, original: Column, pending: Column) -> Column:
    """What an upload is answered with beside its labels; what does not belong to the status is null."""
    safe, held = status == "ai_safe", status == "restricted"
    return F.struct(
        status.alias("status"), F.when(safe, masked_path).alias("aiSafeStoragePath"), F.when(safe | held, masker).alias("masker"), F.when(held, reason).alias("sensitivityReason"),
        F.when(held, original).alias("originalCuratorSensitivity"), F.when((status == "curated") & pending, True).alias("maskingPending"),
    )


def size_text(size: Column) -> Column:
    return F.concat(F.floor(size / (1024 * 1024)).cast("string"), F.lit(" MB"))
