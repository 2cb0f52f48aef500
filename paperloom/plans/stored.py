"""Registered queries of stored tables, objects, exports, tolerant scans and ordered checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.invariants import document_violations, violations
from ..operators import packages
from ..sources import exports, objects, scans
from ..sources.stores import shared_folder
from ..sources.tables import BucketedTable, Log
from .queries import DOCS, labelled, query, table

LINES = "docId string, id string, text string"


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("docId", F.posexplode(F.split("text", "\n")).alias("k", "text")).select("docId", F.concat("docId", F.lit("-"), F.col("k").cast("string")).alias("id"), "text")


@query(DOCS + """SELECT "docId", CAST(count(*) AS BIGINT) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
    SELECT "docId", unnest(CASE WHEN sensitivity = 'Confidential' THEN ['masked'] ELSE string_split(text, chr(10)) END) AS line FROM lab WHERE sensitivity <> 'Restricted') GROUP BY 1""")
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    """A table of all documents' lines; those of confidential ones are replaced by one, those of restricted ones cleared."""
    docs = labelled(spark, d)
    stored = BucketedTable(spark, shared_folder(spark, "lines"), LINES, buckets=16)
    stored.write(lines(docs))
    stored.replace(docs.where("sensitivity = 'Confidential'").select("docId", F.concat("docId", F.lit("-0")).alias("id"), F.lit("masked").alias("text")))
    stored.clear(docs.where("sensitivity = 'Restricted'").select("docId"))
    return stored.read().groupBy("docId").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS docs FROM events JOIN customer ON c_custkey = user_id GROUP BY 1""")
def eval_log_append(spark: SparkSession, d: str) -> DataFrame:
    """A log of all events of known customers, appended in two commits."""
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("evalId"), F.col("user_id").cast("string").alias("docId"), F.col("event_type").alias("stage"))
    events = events.join(known.withColumnRenamed("id", "docId"), "docId", "left_semi").select("evalId", "docId", "stage")
    log = Log(spark, shared_folder(spark, "evals"), "evalId string, docId string, stage string", "evalId", buckets=16)
    for part in ("stage = 'purchase'", "stage <> 'purchase'"):
        log.append(events.where(part), known)
    return log.read().groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("docId").alias("docs"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'upload' END AS "sourceKind" FROM orders""")
def resumable_backfill(spark: SparkSession, d: str) -> DataFrame:
    """All orders as documents without a source kind get one, bucket by bucket; open ones have a problem and stay."""
    given = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("sourceKind"), F.col("o_orderstatus").alias("status"))
    stored = BucketedTable(spark, shared_folder(spark, "orders"), "id bigint, sourceKind string, status string", key="id", buckets=4)
    stored.write(given)
    stored.migrate("source kind", lambda rows: rows.withColumns({"sourceKind": F.coalesce("sourceKind", F.lit("upload")), "problem": F.when(F.col("status") == "O", "open")}), at_once=2)
    return stored.read().select("id", "sourceKind")


@query("""SELECT 'raw/' || doc_id || '/' || lang || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS "contentSha256" FROM documents""")
def object_write(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an object of its own."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat("lang", F.lit(".txt")).alias("fileName"), F.col("text").alias("content"))
    return objects.written_objects(objects.raw_objects(files), shared_folder(spark, "store"))


@query("""WITH s AS (SELECT CAST(event_id AS VARCHAR) AS "evalId", CAST(user_id AS VARCHAR) AS "docId", CAST(ts AS VARCHAR) AS "createdAt", value, CASE WHEN event_type = 'purchase' THEN 'bad' ELSE 'health' END AS stage,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'slide-pdf' WHEN c_custkey IS NOT NULL THEN 'official-doc-pdf' END AS subtype FROM events LEFT JOIN customer ON c_custkey = user_id)
    SELECT "evalId", "docId", CAST(round(value, 3) AS DOUBLE) AS "pageCoverage", CAST(2 AS BIGINT) AS warnings FROM s WHERE subtype = 'official-doc-pdf' AND stage = 'health'""")
def evaluation_export(spark: SparkSession, d: str) -> DataFrame:
    """All events as evaluations, exported as ordered lines and read back."""
    result = F.to_json(F.struct(
        F.struct(F.round("value", 3).alias("pageCoverage"), F.array(F.lit("a"), F.lit("b")).alias("textDensityWarnings"), F.lit(0).alias("tableCandidates")).alias("coverage"), F.struct(F.lit(True).alias("hasPageLocators"), F.lit(False).alias("hasTableLocators")).alias("locatorQuality"),
        F.struct(F.lit(0).alias("oversizedChunks")).alias("contextPackageReadiness"), F.struct(F.lit(0).alias("unmaskablePiiFindings"), F.lit(1.0).alias("maskableChunkRate")).alias("safetyReadiness"),
    ))
    evals = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("evalId"), F.col("user_id").cast("string").alias("docId"), F.lit("r1").alias("revisionId"), F.when(F.col("event_type") == "purchase", "bad").otherwise("health").alias("stage"),
        F.col("ts").cast("string").alias("createdAt"), result.alias("result"), F.lit(None).cast("string").alias("sourceSubtype"),
    )
    docs = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "slide-pdf").otherwise("official-doc-pdf").alias("sourceSubtype"))
    rows, _ = exports.evaluation_samples(evals, docs)
    path = shared_folder(spark, "samples")
    exports.jsonl(rows, path, *exports.sample_order(), shard_rows=10_000)
    back = spark.read.schema(exports.SAMPLES).json(path)
    return back.select("evalId", "docId", "coverage.pageCoverage", F.col("coverage.textDensityWarningsLength").alias("warnings"))


@query(DOCS + """SELECT problem, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN sensitivity = 'Restricted' THEN 'not a JSON object' WHEN lang = 'fr' THEN 'a field has another type'
    WHEN lang = 'es' THEN 'required: sourceHash' WHEN sensitivity = 'Internal' THEN 'unknown sensitivity Secret' ELSE 'none, ' || CASE WHEN lang = 'de' THEN 'dated' ELSE 'epoch' END END AS problem FROM lab) GROUP BY 1""")
def stored_chunk_scan(spark: SparkSession, d: str) -> DataFrame:
    """All documents as stored chunks; by label and language some are broken, and some have no times."""
    docs, none = labelled(spark, d), F.lit(None).cast("string")
    count = F.when(F.col("lang") == "fr", '"many"').otherwise("3")
    fields = F.struct(
        "docId", F.lit("document").alias("sourceType"), F.lit("paragraph").alias("structureType"), "text", F.when(F.col("sensitivity") == "Internal", "Secret").otherwise(F.col("sensitivity")).alias("sensitivity"), "aiUsePolicy",
        F.when(F.col("lang") != "es", "h").otherwise(none).alias("sourceHash"), F.when(F.col("lang") == "de", "2024-01-01T00:00:00.000Z").otherwise(none).alias("createdAt"),
    )
    data = F.concat(F.regexp_replace(F.to_json(fields), r"\}$", ""), F.lit(', "maskedSpansCount": '), count, F.lit("}"))
    given = docs.select(F.concat(F.lit("c"), "docId").alias("id"), F.when(F.col("sensitivity") == "Restricted", F.concat(data, F.lit("]"))).otherwise(data).alias("data"))
    read = scans.stored_chunks(given)
    fine = F.concat(F.lit("none, "), F.when(F.col("chunk.createdAt") == scans.EPOCH, "epoch").otherwise("dated"))
    return read.select(F.coalesce("problem", fine).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(DOCS + """, a AS (SELECT "docId", sensitivity, lang,
        CASE WHEN sensitivity = 'Public' THEN ['structured(output): no output'] WHEN sensitivity = 'Internal' THEN [] ELSE ['structured(output): unknown label Secret'] END AS one, sensitivity = 'Internal' AS done1,
        CASE lang WHEN 'de' THEN ['structured(text) (JSON.parse): not JSON'] WHEN 'fr' THEN ['structured(text): unknown label Other'] ELSE [] END AS two, lang = 'en' AS done2 FROM lab)
    SELECT "docId", CASE WHEN done1 THEN 'Internal' WHEN done2 THEN 'Public' END AS label, array_to_string(CASE WHEN done1 THEN one ELSE list_concat(one, two) END, '|') AS tried FROM a""")
def model_attempts(spark: SparkSession, d: str) -> DataFrame:
    """A classifier's structured answer and its text for every document, of which some do not parse and some do not fit."""
    docs = labelled(spark, d)
    structured = F.when(F.col("sensitivity") != "Public", F.concat(F.lit('{"label":"'), F.when(F.col("sensitivity") == "Internal", "Internal").otherwise("Secret"), F.lit('"}')))
    said = F.when(F.col("lang") == "de", "I think it is public").when(F.col("lang") == "fr", '```json\n{"label":"Other"}\n```').when(F.col("lang") == "en", '```\n{"label":"Public"}\n```').otherwise(" ")
    invalid = lambda v: F.when(~F.coalesce(v["label"].isin(*scans.SENSITIVITIES), F.lit(False)), F.concat(F.lit("unknown label "), F.coalesce(v["label"], F.lit("null"))))
    tried = scans.attempts([("structured(output)", structured, False), ("structured(text)", said, True)], "label string", invalid)
    got = docs.select("docId", tried.alias("t"))
    return got.select("docId", F.col("t.value.label").alias("label"), F.array_join(F.transform("t.attempts", lambda a: F.concat(a["kind"], F.lit(": "), a["error"])), "|").alias("tried"))


@query("""WITH s AS (SELECT l_orderkey AS selection, CASE WHEN l_linestatus = 'O' THEN 'included' ELSE 'excluded' END AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i, l_suppkey % 2 AS d, l_partkey % 3 AS c, CASE WHEN l_returnflag = 'R' THEN 'restricted_sensitivity' ELSE 'purpose_mismatch' END AS reason FROM lineitem),
    f AS (SELECT *, min(CASE WHEN side = 'included' THEN i END) OVER (PARTITION BY selection, d, c) AS fi, min(CASE WHEN side = 'excluded' THEN i END) OVER (PARTITION BY selection, d, c) AS fe FROM s),
    x AS (SELECT selection, 0 AS a, i, 0 AS k, side || '.' || i || '.chunkId' AS path, 'duplicate chunk ref (docId + chunkId) also at included[' || fi || ']' AS message FROM f WHERE side = 'included' AND i > fi
        UNION ALL SELECT selection, 1, i, 0, side || '.' || i || '.chunkId', 'duplicate chunk ref (docId + chunkId) also at excluded[' || fe || ']' FROM f WHERE side = 'excluded' AND i > fe
        UNION ALL SELECT selection, 1, i, 1, side || '.' || i || '.chunkId', 'chunk ref must not appear in both included and excluded' FROM f WHERE side = 'excluded' AND fi IS NOT NULL
        UNION ALL SELECT selection, 2, i, 0, side || '.' || i || '.reason', 'Strategist must not emit safety_gate-origin reason: ' || reason FROM f WHERE side = 'excluded' AND reason = 'restricted_sensitivity')
    SELECT selection, row_number() OVER (PARTITION BY selection ORDER BY a, i, k) AS ordinal, path, message FROM x""")
def selection_issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders as selections of chunks; open lines are included, shipped ones excluded."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")) - 1
    refs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("selection"), F.when(F.col("l_linestatus") == "O", "included").otherwise("excluded").alias("side"), place.alias("index"), (F.col("l_suppkey") % 2).alias("docId"), (F.col("l_partkey") % 3).alias("chunkId"),
        F.when(F.col("l_returnflag") == "R", "restricted_sensitivity").otherwise("purpose_mismatch").alias("reason"),
    )
    return packages.selection_issues(refs)


@query(DOCS + """SELECT "docId" AS id, 'doc-' || "docId" || '.txt' AS "fileName", status, sensitivity, 'by label' AS rationale, CASE WHEN lang = 'de' THEN 'true' ELSE 'absent' END AS "maskingPending" FROM lab WHERE status <> 'masking' AND lang <> 'fr'""")
def inventory_projection(spark: SparkSession, d: str) -> DataFrame:
    """All documents as stored ones; those in masking are not at their end, French ones lack their curator's block."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    curator = F.when(F.col("lang") != "fr", F.struct("sensitivity", "aiUsePolicy", F.lit("by label").alias("rationale")))
    docs = labelled(spark, d).select(
        F.col("docId").alias("id"), F.concat(F.lit("doc-"), "docId", F.lit(".txt")).alias("fileName"), F.concat(F.lit("raw/"), "docId").alias("storagePath"), "status", now.alias("createdAt"), now.alias("updatedAt"), F.lit("t").alias("documentType"), F.lit("b").alias("businessDomain"), "sensitivity",
        F.lit("current").alias("freshness"), F.lit(True).alias("isAuthoritativeCandidate"), "aiUsePolicy", F.lit("curator").alias("sensitivitySource"), curator.alias("curator"), F.lit("upload").alias("sourceKind"), (F.col("lang") == "de").alias("maskingPending"),
    )
    return packages.inventory_rows(docs).select("id", "fileName", "status", "sensitivity", "rationale", F.coalesce(F.col("maskingPending").cast("string"), F.lit("absent")).alias("maskingPending"))


@query(DOCS + """SELECT "docId" AS id, path FROM (SELECT *, doc_id % 13 AS k FROM lab), (SELECT unnest(range(0, 13)) AS r, unnest(['aiSafeStoragePath', 'sensitivitySource', 'originalCuratorSensitivity', 'curator', 'masker', 'masker', 'masker.sourceContentHash', 'status', 'status', 'status', 'sensitivityReason', 'sourceKind', 'sourceKind']) AS path)
    WHERE r = k OR k = 3 AND r = 7""")
def document_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a stored one that breaks the rule of its number modulo 13 (one of them must break a second)."""
    k, none = F.col("doc_id") % 13, F.lit(None).cast("string")
    pick = lambda otherwise, **cases: F.coalesce(*(F.when(k == int(n[1:]), F.lit(v)) for n, v in cases.items()), otherwise)
    status = pick(F.lit("curated"), r1="masking", r4="ai_safe", r6="masking", r8="blocked", r9="restricted", r10="restricted")
    policy = pick(F.lit("direct"), r6="requires_masking", r9="requires_masking", r10="requires_masking", r7="blocked")
    decided = k.isin(5, 6, 9, 10)
    masker = F.when(decided, F.struct(F.when(k == 10, "restricted_promoted").when(k == 9, "ai_safe_ready").otherwise("residual").alias("decision"), F.when(k == 6, "other").otherwise("h").alias("sourceContentHash")))
    from_masker = k.isin(1, 9, 10)
    given = labelled(spark, d).select(
        F.col("docId").alias("id"), status.alias("status"), F.when(from_masker & (k != 1), "Restricted").otherwise(F.lit("Internal")).alias("sensitivity"), F.when(from_masker, "blocked").otherwise(policy).alias("aiUsePolicy"), F.when(from_masker, "masker").otherwise("curator").alias("sensitivitySource"),
        F.when(from_masker | (k == 2), "Confidential").alias("originalCuratorSensitivity"), F.when(k == 9, "why").otherwise(none).alias("sensitivityReason"), F.lit("h").alias("contentSha256"), F.lit(False).alias("maskingPending"), F.when(k != 3, F.struct(policy.alias("aiUsePolicy"))).alias("curator"), masker.alias("masker"),
        F.when((k == 0), "masked/x").alias("aiSafeStoragePath"), F.when(k == 11, "other").when(k == 12, "google_workspace").otherwise(F.lit("upload")).alias("sourceKind"), F.lit(None).cast("struct<provider:string>").alias("externalSource"),
    )
    return violations(given, "id", document_violations(given)).select("id", "path")
