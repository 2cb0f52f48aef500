"""Registered queries of states, answers, names, places and package texts, and their SQL. They run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, policy, text
from ..operators import chunking, packages, reports
from .queries import DOCS, SQL, _inventory, labelled, mask_sql, query, sql_trim, table


def none() -> Column:
    return F.lit(None).cast("string")


@query(DOCS + f""", s AS (SELECT *, CASE WHEN status = 'masking' AND lang = 'fr' THEN 'ai_safe' ELSE status END AS st, sensitivity = 'Restricted' OR "aiUsePolicy" = 'blocked' AS held, "aiUsePolicy" = 'requires_masking' AND lang <> 'fr' AS waits FROM lab)
    SELECT "docId", sensitivity = 'Restricted' AND lang = 'de' AS promoted, held, waits, st IN ('curated', 'ai_safe') AND lang <> 'es' AND NOT held AND NOT waits AND {sql_trim("coalesce(text, '')")} <> '' AS safe,
        CASE WHEN st = 'ai_safe' THEN 'masked/' || "docId" WHEN st = 'curated' AND lang <> 'de' THEN 'raw/' || "docId" END AS path,
        CASE WHEN held THEN 'safety gate: sensitivity=' || sensitivity || ', aiUsePolicy=' || "aiUsePolicy" WHEN "aiUsePolicy" = 'requires_masking' THEN 'safety gate: aiUsePolicy=requires_masking だが maskedText が未生成' END AS rationale FROM s""")
def export_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds each document back from an export and where its body lies; French confidential ones are masked, German ones wait, Spanish ones do not load."""
    docs = labelled(spark, d).withColumn("st", F.when((F.col("status") == "masking") & (F.col("lang") == "fr"), "ai_safe").otherwise(F.col("status")))
    s, p, evaluated = F.col("sensitivity"), F.col("aiUsePolicy"), F.col("lang") == "fr"
    return docs.select(
        "docId", policy.was_promoted(F.when(F.col("lang") == "de", "masker").otherwise("curator"), s).alias("promoted"), policy.blocked_for_ai(s, p).alias("held"), policy.needs_masker(p, evaluated).alias("waits"),
        policy.safe_for_export(F.col("st"), F.when(F.col("lang") == "es", "not there"), s, p, evaluated, F.col("text")).alias("safe"),
        policy.body_path(F.col("st"), p, F.col("lang") == "de", F.concat(F.lit("raw/"), "docId"), F.concat(F.lit("masked/"), "docId")).alias("path"), policy.gate_rationale(policy.gate_reason(s, p, none()), s, p).alias("rationale"),
    )


@query(DOCS + """, s AS (SELECT *, doc_id % 3 = 0 AS up, CASE WHEN status <> 'masking' THEN status WHEN doc_id % 3 = 0 THEN 'restricted' ELSE 'ai_safe' END AS st FROM lab)
    SELECT "docId", up = coalesce(regexp_matches(text, '[0-9]'), false) AND doc_id % 7 BETWEEN 1 AND 5 AS consistent,
        CASE WHEN up THEN 'r' || CASE WHEN doc_id % 7 > 0 THEN ' (' || array_to_string(list_transform(range(0, doc_id % 7), lambda i: 'x'), '; ') || ')' ELSE '' END END AS "sensitivityReason",
        '{"status":"' || st || '"' || CASE WHEN st = 'ai_safe' THEN ',"aiSafeStoragePath":"masked/' || "docId" || '","masker":"m"' WHEN st = 'restricted' THEN ',"masker":"m","sensitivityReason":"why","originalCuratorSensitivity":"Confidential"'
            WHEN st = 'curated' AND lang = 'de' THEN ',"maskingPending":true' ELSE '' END || '}' AS answer FROM s""")
def risk_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a risk check agrees with itself, what a promotion notes, and what an upload is answered with, for every document."""
    docs, up = labelled(spark, d), F.col("doc_id") % 3 == 0
    recommended, reasons = F.when(up, "Restricted").otherwise("Confidential"), F.array_repeat(F.lit("x"), (F.col("doc_id") % 7).cast("int"))
    st = F.when(F.col("status") != "masking", F.col("status")).otherwise(F.when(up, "restricted").otherwise("ai_safe"))
    answer = F.to_json(policy.response(st, F.concat(F.lit("masked/"), "docId"), F.lit("m"), F.lit("why"), F.lit("Confidential"), F.col("lang") == "de"))
    rest = {c: none() for c in ("originalCuratorSensitivity", "sensitivitySource", "sensitivityReason")}
    got = policy.promoted(docs.withColumns(rest), recommended, F.lit("r"), reasons)
    return got.select("docId", policy.risk_consistent(F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)), recommended, reasons).alias("consistent"), "sensitivityReason", answer.alias("answer"))


@query("""WITH s AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'slide-pdf' WHEN 1 THEN 'scan-pdf' ELSE 'official-doc-pdf' END AS sub, CASE l_linestatus WHEN 'O' THEN 'gemini-vertex' ELSE 'gemini-vertex-ocr' END AS conv, l_returnflag = 'R' AS dest, l_quantity > 25 AS counted, CASE l_returnflag WHEN 'A' THEN 'failed' ELSE 'success' END AS res, l_partkey % 600 AS http FROM lineitem),
    m AS (SELECT *, ' for converterId=' || conv || ' on sourceSubtype=' || sub AS tail, sub = 'scan-pdf' AND conv = 'gemini-vertex-ocr' AS scan FROM s)
    SELECT CASE WHEN sub <> 'official-doc-pdf' AND NOT dest THEN 'document.convert: inferenceDestination is required' || tail WHEN sub = 'official-doc-pdf' AND dest THEN 'document.convert: inferenceDestination must not be set' || tail END AS inference,
        CASE WHEN scan AND res = 'success' AND NOT counted THEN 'document.convert: conversion.unmaskablePiiFindings.count is required' || tail || ' with result=success' WHEN NOT scan AND counted THEN 'document.convert: conversion.unmaskablePiiFindings must not be set' || tail END AS unmaskable,
        CASE WHEN http IN (401, 403) THEN 'drive_forbidden' WHEN http = 404 THEN 'drive_not_found' WHEN http = 413 THEN 'too_large' WHEN http >= 500 THEN 'drive_unavailable' WHEN http >= 400 THEN 'drive_error' END AS drive, count(*) AS n FROM m GROUP BY ALL""")
def conversion_audits(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as conversions: which rules of the audit they break, and which error their status code is."""
    sub = F.when(F.col("l_suppkey") % 3 == 0, "slide-pdf").when(F.col("l_suppkey") % 3 == 1, "scan-pdf").otherwise("official-doc-pdf")
    conv, flag = F.when(F.col("l_linestatus") == "O", "gemini-vertex").otherwise("gemini-vertex-ocr"), F.col("l_returnflag")
    got = table(spark, d, "lineitem").select(
        policy.inference_violation(sub, conv, F.when(flag == "R", "us")).alias("inference"),
        policy.unmaskable_violation(sub, conv, F.when(flag == "A", "failed").otherwise("success"), F.when(F.col("l_quantity") > 25, 1)).alias("unmaskable"), policy.drive_error(F.col("l_partkey") % 600).alias("drive"),
    )
    return got.groupBy("inference", "unmaskable", "drive").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'user' || c_custkey || '@dept' || c_nationkey || '.example.com' END AS email,
    CASE WHEN c_custkey % 7 = 0 THEN 'team-a' WHEN c_custkey % 5 > 0 THEN 'dept' || c_nationkey || '.example.com' END AS tenant,
    CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.' || c_nationkey WHEN c_custkey % 3 = 0 THEN '10.1.1.1' ELSE 'unknown' END AS address,
    CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 'acme-corp iap a@x.jp' END WHEN c_custkey % 5 > 0 THEN 'dept' || c_nationkey || '.example.com iap user' || c_custkey || '@dept' || c_nationkey || '.example.com' ELSE 'local-dev local-dev local-dev@localhost.local' END AS auth FROM customer""")
def request_identities(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests: the address in their proxy's header, tenants, client addresses, and who they are taken for."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    header = F.when(k % 5 > 0, F.concat(F.lit("accounts.google.com:User"), k.cast("string"), F.lit("@Dept"), n, F.lit(".Example.COM "))).otherwise("accounts.google.com:nobody")
    email = text.proxy_email(header)
    auth = policy.auth_context(F.when(k % 4 == 0, "Acme Corp").otherwise(""), F.when(k % 8 == 0, "a@x.jp").otherwise("nobody"), header, local=True)
    return table(spark, d, "customer").select(
        k, email.alias("email"), text.tenant_of_email(email, F.when(k % 7 == 0, " Team A! ")).alias("tenant"),
        text.client_address(F.when(k % 2 == 0, F.concat(F.lit(" 10.0.0."), n, F.lit(" , 10.9.9.9"))), F.when(k % 3 == 0, " 10.1.1.1 ")).alias("address"),
        F.concat_ws(" ", auth["tenantId"], auth["provider"], auth["email"]).alias("auth"),
    ).withColumn("auth", F.nullif("auth", F.lit("")))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://docs.google.com/document/d/' || url || '.TXT' ELSE url || ' ..' END AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'docs' ELSE 'sheets' END AS kind, left(trim(regexp_replace(trim(regexp_replace(left(trim(replace(replace(url, '/', '_'), '\', '_')), 200), '(?i)\.txt$', '')), '\.+$', '')), 195) || '.txt' AS name,
        left(regexp_replace(url, '[^\p{L}\p{N}_-]+', '_', 'g'), 30) AS slug, CAST(page_id * 300000 // 1048576 AS VARCHAR) || ' MB' AS size FROM p""")
def import_names(spark: SparkSession, d: str) -> DataFrame:
    """Pages as imports: what kind of file an address is, its file name, slug and size."""
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://docs.google.com/document/d/"), "url", F.lit(".TXT"))).otherwise(F.concat("url", F.lit(" .."))).alias("url"))
    u = F.col("url")
    return pages.select("page_id", policy.import_kind(u).alias("kind"), text.workspace_file_name(u, ".txt").alias("name"), text.slug(u).alias("slug"), policy.size_text(F.col("page_id") * 300000).alias("size"))


@query("""WITH s AS (SELECT o_orderkey, greatest(o_orderkey % 1000, 1) AS r, greatest(o_orderkey % 703, 1) AS c FROM orders), a AS (SELECT *, 'A1:' || CASE WHEN c > 26 THEN chr(CAST(64 + (c - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INTEGER)) || r AS range FROM s)
    SELECT o_orderkey, range, c AS last_column, r AS last_row, CASE WHEN o_orderkey % 2 = 0 THEN 'book.xlsx (sheet=S' || o_orderkey || ', range=' || range || ')' ELSE 'book.xlsx' END AS label FROM a""")
def sheet_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sheets of some rows and columns: their ranges, written and read, and what a reader is shown as their source."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, text.a1_range(k % 1000, k % 703).alias("range"))
    at = F.struct(F.when(k % 2 == 0, "spreadsheet").otherwise("paragraph").alias("kind"), F.concat(F.lit("S"), k.cast("string")).alias("sheetName"), "range")
    return o.withColumn("at", text.parsed_range(F.col("range"))).select(k, "range", "at.last_column", "at.last_row", policy.source_label(F.lit("book.xlsx"), at).alias("label"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d %H:%M') || ' JST' AS tokyo, user_id || ':' || event_type || ':' || event_id AS "evalId", user_id || ':' || event_type AS "docId", CAST(event_id AS VARCHAR) AS revision FROM events""")
def evaluation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Events as evaluations of documents whose ids hold a colon: their times and ids, put together and taken apart."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.eval_id(F.concat_ws(":", "user_id", "event_type"), F.col("event_id").cast("string")).alias("evalId"))
    e = e.withColumn("p", text.eval_id_parts(F.col("evalId")))
    return e.select("event_id", text.iso_millis(F.col("ts")).alias("iso"), text.tokyo_time(F.col("ts")).alias("tokyo"), "evalId", F.col("p.doc_id").alias("docId"), "p.revision")


@query("""WITH f AS (SELECT c_custkey, [CASE WHEN c_custkey % 2 = 0 THEN 'pdf-conversion' END, CASE WHEN c_custkey % 3 = 0 THEN 'pdf-conversion-subtype-2' END, CASE WHEN c_custkey % 5 = 0 AND c_nationkey % 2 = 1 THEN 'pdf-conversion-subtype-3' END] AS l FROM customer),
    n AS (SELECT c_custkey, list_filter(l, lambda x: x IS NOT NULL) AS l FROM f)
    SELECT c_custkey, CASE WHEN len(l) = 1 THEN l[1] END AS "flagId", CASE WHEN len(l) = 0 THEN 'not_enabled' WHEN len(l) > 1 THEN 'conflicting_flags' END AS code FROM n""")
def flag_choices(spark: SparkSession, d: str) -> DataFrame:
    """For every customer as a tenant the one conversion flag that is on, of three: one by default, one by a list of tenants, one that may have expired."""
    k, nobody = F.col("c_custkey"), F.array().cast("array<string>")
    flag = lambda name, on, tenants, ends: F.struct(F.lit(name).alias("flagId"), on.alias("defaultEnabled"), tenants.alias("enabledTenants"), ends.cast("string").alias("expiresAt"))
    three = F.array(
        flag("pdf-conversion", k % 2 == 0, nobody, none()), flag("pdf-conversion-subtype-2", F.lit(False), F.when(k % 3 == 0, F.array(k.cast("string"))).otherwise(nobody), none()),
        flag("pdf-conversion-subtype-3", k % 5 == 0, nobody, F.when(F.col("c_nationkey") % 2 == 0, "2020-01-01T00:00:00Z").otherwise("2999-01-01T00:00:00Z")),
    )
    flags = table(spark, d, "customer").select(k, F.explode(three).alias("f")).select(k, "f.*")
    return policy.flag_choice(flags, k.cast("string"), F.lit("2024-01-01 00:00:00").cast("timestamp"), by=("c_custkey",))


@query(DOCS + """, r AS (SELECT "docId", "aiUsePolicy" = 'blocked' OR status = 'masking' OR lang = 'es' AS h FROM lab)
    SELECT count_if(NOT h) AS included, CAST(0 AS BIGINT) AS excluded, count_if(h) AS "humanReview", coalesce(min(CASE WHEN NOT h THEN "docId" END), min("docId"), 'context-package') AS "auditTarget" FROM r""", whole=("included", "humanReview"))
def package_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many rows a package of all documents has of each kind, and which document its audit names."""
    rows = packages.document_package(_inventory(spark, d))
    both = packages.package_counts(rows).withColumn("auditTarget", none()).unionByName(packages.audit_target(rows).select(*(F.lit(None).cast("bigint").alias(c) for c in ("included", "excluded", "humanReview")), F.col("docId").alias("auditTarget")))
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


@query(f"""SELECT d.doc_id, m."maskedContent" AS "maskedText", m.spans AS "maskedSpansCount" FROM ({DOCS} SELECT doc_id FROM lab WHERE {sql_trim("text")} <> '') d LEFT JOIN (
    {mask_sql(DOCS + f'''SELECT doc_id, {sql_trim("text")} AS text FROM lab WHERE "aiUsePolicy" = 'requires_masking' AND {sql_trim("text")} <> '' ''')}) m ON m.doc_id = d.doc_id""")
def chunk_masking(spark: SparkSession, d: str) -> DataFrame:
    """All documents' chunks; those that need masking are masked by all rules, others pass as they are."""
    got = masking.mask_chunks(chunking.plain_text_chunks(labelled(spark, d)))
    return got.select(F.col("docId").cast("bigint").alias("doc_id"), "maskedText", "maskedSpansCount")


@query("""WITH l AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '第' || c_custkey || '章 ' || c_name WHEN 1 THEN '第 ' || c_custkey || ' 節' WHEN 2 THEN c_custkey || '. ' || c_name WHEN 3 THEN '（' || c_custkey || '）' ELSE c_name END AS line FROM customer)
    SELECT c_custkey, CASE WHEN length(line) <= 60 THEN CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 END END AS level, CASE WHEN c_custkey % 5 < 4 AND length(line) <= 60 THEN 'heading' ELSE 'paragraph' END || ' ' || line || '|paragraph ' || c_name || ' ' || line AS segments FROM l""")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Customers as pages: a numbered line in one of four forms, or a plain one, then a paragraph of two lines."""
    k = F.col("c_custkey")
    s, n = k.cast("string"), F.col("c_name")
    line = F.when(k % 5 == 0, F.concat(F.lit("第"), s, F.lit("章 "), n)).when(k % 5 == 1, F.concat(F.lit("第 "), s, F.lit(" 節"))).when(k % 5 == 2, F.concat(s, F.lit(". "), n)).when(k % 5 == 3, F.concat(F.lit("（"), s, F.lit("）"))).otherwise(n)
    page = F.concat(F.lit(" \r\n"), line, F.lit(" \r\n\r\n\r\n"), n, F.lit(" \r"), line)
    found = F.array_join(F.transform(chunking.page_segments(page), lambda x: F.concat(x["kind"], F.lit(" "), x["text"])), "|")
    return table(spark, d, "customer").select(k, chunking.heading_level(line).alias("level"), found.alias("segments"))


@query(DOCS + f""", b AS (SELECT *, {sql_trim('text')} AS body FROM lab WHERE {sql_trim('text')} <> '')
    SELECT "docId", CASE WHEN length(body) > 100 THEN left(body, 100) || '…' ELSE body END AS error, concat('### chunk', chr(10), '- fileName: doc-', "docId", '.txt', chr(10), '- documentType: (null)', chr(10), '- docId: ', "docId", chr(10), '- chunkId: ', "docId", ':text:paragraph', chr(10), '- locator: {{"kind":"paragraph"}}', chr(10),
        '- sensitivity: ', sensitivity, chr(10), '- aiUsePolicy: ', "aiUsePolicy", chr(10), '```text', chr(10), CASE WHEN lang = 'de' THEN 'masked' WHEN length(body) > 1200 THEN left(body, 1200) || '…(truncated)' ELSE body END, chr(10), '```') AS prompt FROM b""")
def selection_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a selection model is shown of every document's chunk, and a chunk's text as a stored error; German ones are masked."""
    chunks = chunking.plain_text_chunks(labelled(spark, d), keep=("lang",)).withColumn("maskedText", F.when(F.col("lang") == "de", "masked"))
    parent = F.struct(F.concat(F.lit("doc-"), "docId", F.lit(".txt")).alias("fileName"), none().alias("documentType"))
    return reports.prompt_chunks(chunks.withColumn("parent", parent)).select("docId", text.shortened(F.col("text"), 100).alias("error"), "prompt")


#: The package of ``package_markdown``: the last 100 documents' chunks, in the order of their ids.
SQL["package_markdown"] = DOCS + f""", c AS (SELECT *, {sql_trim('text')} AS body, CASE WHEN "aiUsePolicy" = 'blocked' THEN 'safety gate: sensitivity=' || sensitivity || ', aiUsePolicy=blocked [safety: restricted_sensitivity]'
        WHEN "aiUsePolicy" = 'requires_masking' THEN 'safety gate: aiUsePolicy=requires_masking だが maskedText が未生成 [safety: masking_required_unavailable]' END AS why, CASE WHEN "aiUsePolicy" = 'blocked' THEN 'restricted_sensitivity' ELSE 'masking_required_unavailable' END AS gate
        FROM (SELECT * FROM lab ORDER BY doc_id DESC LIMIT 100)), r AS (SELECT * FROM c WHERE body <> ''),
    t AS (SELECT count_if(why IS NULL) AS i, count_if(why IS NOT NULL) AS h, string_agg(CASE WHEN why IS NULL THEN '- doc-' || "docId" || '.txt' || chr(10) || '  - Reason: fits the purpose' || chr(10) || '  - Source type: その他' || chr(10) || '  - Sensitivity: ' || sensitivity END, chr(10) ORDER BY doc_id) AS inc,
        string_agg(CASE WHEN why IS NOT NULL THEN '- doc-' || "docId" || '.txt' || chr(10) || '  - Reason: ' || why || chr(10) || '  - Status: ' || gate END, chr(10) ORDER BY doc_id) AS exc,
        string_agg(CASE WHEN why IS NULL THEN '## Source: doc-' || "docId" || '.txt' || chr(10) || chr(10) || '```text' || chr(10) || body || chr(10) || '```' END, chr(10) || chr(10) ORDER BY doc_id) AS src FROM r)
    SELECT replace(concat('# AI-Ready Context Package~~## Package Manifest~~- Purpose: review~- Generated at: 2024/01/01 09:00 JST~- Source documents reviewed: 100~- Included documents: ', i, '~- Excluded documents: 0~- Human review required: ', h,
        '~~## Instructions for Downstream AI~~{'~'.join(packages.INSTRUCTIONS)}~~## Included Documents~~'), '~', chr(10)) || coalesce(inc, '- None') || replace('~~## Excluded Documents~~', '~', chr(10)) || coalesce(exc, '- None')
        || replace('~~## Missing Knowledge~~- None~~## Questions for Human Owner~~1. No questions.~~---~~# Full AI-Ready Sources~~', '~', chr(10)) || coalesce(src, 'No AI-ready sources were included.') || chr(10) AS markdown FROM t"""


#: The parts of ``oversize_split``. Sizes of JSON texts add up, so a part grows as long as its own and the next piece's fit; a piece that
#: does not fit alone is cut by halving steps.
SQL["oversize_split"] = DOCS.replace("WITH docs", "WITH RECURSIVE docs", 1) + f""", given AS (SELECT "docId", text, 6000 - strlen(concat('{{"docId":"', "docId", '","schemaVersion":1,"sourceType":"pdf","structureType":"paragraph","locator":{{"kind":"pdf","page":1,"paragraphId":"b1"}},"sensitivity":"', sensitivity, '","aiUsePolicy":"', "aiUsePolicy",
        '","sensitivitySource":"inherited","extractionProvider":"pdf","createdAt":"1970-01-01T00:00:00.000Z","updatedAt":"1970-01-01T00:00:00.000Z","id":"', "docId", ':b1","text":"","sourceHash":"', repeat('0', 64), '"}}')) AS room FROM lab WHERE text IS NOT NULL),
    whole AS (SELECT *, strlen(to_json(text)) - 2 <= room AS fits FROM given),
    cut AS (SELECT "docId", room - strlen(':part-999:part-999,"extractionWarnings":["split=999/999 (exceeded 6000B; paragraph-aligned)"]') AS room, CASE WHEN len(blank) > 1 THEN blank WHEN len(lines) > 0 THEN lines ELSE [text] END AS p FROM (
        SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: {sql_trim("x")}), lambda x: x <> '') AS blank, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_trim("x")}), lambda x: x <> '') AS lines FROM whole WHERE NOT fits)),
    steps AS (
        SELECT "docId", room, p, 1 AS i, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS rest, CAST(NULL AS VARCHAR) AS part, 0 AS k FROM cut
        UNION ALL SELECT "docId", room, p, CASE WHEN rest IS NULL AND (joins OR held IS NULL) THEN i + 1 ELSE i END, CASE WHEN joins THEN joined END, CASE WHEN rest IS NOT NULL THEN nullif(substr(rest, n + 1), '') WHEN NOT joins AND held IS NULL THEN piece END,
            CASE WHEN rest IS NOT NULL THEN left(rest, n) WHEN NOT joins THEN held END, CASE WHEN rest IS NOT NULL OR NOT joins AND held IS NOT NULL THEN k + 1 ELSE k END
        FROM (SELECT *, p[i] AS piece, CASE WHEN held IS NULL THEN p[i] ELSE concat(held, chr(10), chr(10), p[i]) END AS joined, rest IS NULL AND i <= len(p) AND CASE WHEN held IS NULL THEN 0 ELSE strlen(to_json(held)) + 2 END + strlen(to_json(p[i])) - 2 <= room AS joins,
            greatest(1, list_reduce([0, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda a, b: CASE WHEN strlen(to_json(left(rest, a + b))) - 2 <= room THEN a + b ELSE a END)) AS n FROM steps WHERE i <= len(p) OR rest IS NOT NULL OR held IS NOT NULL)),
    parts AS (SELECT "docId", part, k, max(k) OVER (PARTITION BY "docId") AS n FROM steps WHERE part IS NOT NULL),
    every AS (SELECT "docId", text, 0 AS k, length(text) AS chars, '' AS tail, CAST(NULL AS VARCHAR) AS note FROM whole WHERE fits UNION ALL SELECT "docId", text, k, length(part), ':part-' || k, 'split=' || k || '/' || n || ' (exceeded 6000B; paragraph-aligned)' FROM parts JOIN whole USING ("docId"))
    SELECT "docId" || ':b1' || tail AS id, "docId", CAST(k AS INTEGER) AS part, CAST(chars AS INTEGER) AS chars, note, sha256(concat('KNOWLEDGE_CHUNK_SOURCE_HASH_V1', chr(0), 'pdf:1:b1', tail, chr(0), text)) AS "sourceHash" FROM every"""
