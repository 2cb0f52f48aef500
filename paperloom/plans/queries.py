"""Registered queries over the generated tables. They run over whole tables; ``SQL`` has the same in SQL.

The tables have no labels of the data model, so a document's sensitivity comes from its quality and toxicity:
toxic is Restricted, low quality Confidential, other labelled ones Internal, the rest Public. This stands in for
the injected classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masking, policy, text
from ..functions.invariants import chunk_violations, document_violations, violations
from ..operators import chunking, columns, compare, evaluation, packages, reports
from ..sources import layouts
from . import lifecycle


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with docId, sensitivity, aiUsePolicy and status after the classifier."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    s = F.when(F.col("toxic") == 1, "Restricted").when(F.col("quality") == 0, "Confidential").when(F.col("quality").isNotNull(), "Internal").otherwise("Public")
    docs = table(spark, d, "documents").join(labels, "doc_id", "left").withColumn("sensitivity", s)
    docs = docs.withColumn("aiUsePolicy", policy.policy_of(F.col("sensitivity")))
    return docs.withColumns({"docId": F.col("doc_id").cast("string"), "status": policy.status_of_policy(F.col("aiUsePolicy"))})


DOCS = """WITH docs AS (
    SELECT d.*, CAST(d.doc_id AS VARCHAR) AS "docId",
        CASE WHEN l.toxic = 1 THEN 'Restricted' WHEN l.quality = 0 THEN 'Confidential' WHEN l.quality IS NOT NULL THEN 'Internal' ELSE 'Public' END AS sensitivity
    FROM documents d LEFT JOIN labels l USING (doc_id)
), pol AS (
    SELECT *, CASE WHEN sensitivity IN ('Public', 'Internal') THEN 'direct' WHEN sensitivity = 'Confidential' THEN 'requires_masking' ELSE 'blocked' END AS "aiUsePolicy" FROM docs
), lab AS (
    SELECT *, CASE "aiUsePolicy" WHEN 'direct' THEN 'curated' WHEN 'blocked' THEN 'blocked' ELSE 'masking' END AS status FROM pol
) """
WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


QUERIES, SQL = {}, {}


def query(sql: str | None = None, whole: tuple[str, ...] = ()):
    """Registers a query; ``whole`` names results that DuckDB makes wider than 64 bits."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in whole)
            SQL[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if whole else sql
        return f

    return add


@query(DOCS + """SELECT sensitivity, "aiUsePolicy", status, count(*) AS n FROM lab GROUP BY ALL""")
def policy_by_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("sensitivity", "aiUsePolicy", "status").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(\"updatedAt\" AS VARCHAR) AS \"updatedAt\", status FROM (SELECT o_orderkey AS id, o_orderdate AS \"updatedAt\", o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) WHERE status = 'F'")
def inventory_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updatedAt"), F.col("o_orderstatus").alias("status"))
    return packages.top_inventory(docs, 100, F.col("status") == "F").withColumn("updatedAt", F.col("updatedAt").cast("string"))


@query(DOCS + """SELECT coalesce(reason, 'passed') AS reason, lang, count(*) AS n FROM (
    SELECT lang, CASE WHEN sensitivity = 'Restricted' OR "aiUsePolicy" = 'blocked' THEN 'restricted_sensitivity'
        WHEN "aiUsePolicy" = 'requires_masking' AND NOT regexp_matches(text, '@') THEN 'masking_required_unavailable' END AS reason FROM lab) GROUP BY ALL""")
def safety_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    chunks = labelled(spark, d).withColumn("maskedText", F.when(F.col("text").contains("@"), F.col("text")))
    return packages.gated(chunks).groupBy(F.coalesce("gateReason", F.lit("passed")).alias("reason"), "lang").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS hits FROM documents")
def pii_rule_hits_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(masking.finder(masking.RULES[:1])(F.col("text"))).cast("bigint").alias("hits"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '〒?{WS}*[0-9]{{3}}-[0-9]{{4}}\b')) AS BIGINT) AS postal, CAST(len(regexp_extract_all(text, '(?i)\b[0-9]{{2,4}}-[0-9X]{{2,4}}-[0-9X]{{4}}\b')) AS BIGINT) AS phone FROM documents")
def pii_rule_hits_digits(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", masking.finder(masking.RULES[1:3])(F.col("text")).alias("s"))
    count = lambda rule: F.size(F.filter("s", lambda x: x["ruleId"] == rule)).cast("bigint")
    return found.select("doc_id", count("postal_hyphen").alias("postal"), count("phone_like").alias("phone"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[REDACTED:EMAIL]', 'g') AS masked FROM documents")
def masked_text_email(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("_done", masking.redactor(masking.RULES[:1])(F.col("text")))
    return docs.select("doc_id", masking.masked_text(F.col("text"), F.col("_done")).alias("masked"))


#: Fixed values, in order: rule, type, what a match may begin with, what is masked. RE2 looks neither back nor ahead, so runs
#: of digits are judged by their length, and the short form of a representative also matches inside the long one, which
#: overlaps it and begins earlier.
RE2_RULES = (
    ("email", "EMAIL", "", EMAIL),
    ("phone_like", "PHONE", "", r"\b[0-9]{2,4}-[0-9Xx]{2,4}-[0-9Xx]{4}\b"),
    ("postal_hyphen", "POSTAL_CODE", "", rf"〒?{WS}*[0-9]{{3}}-[0-9]{{4}}\b"),
    ("mynumber_12", "JP_MYNUMBER", "", "[0-9]+"),
    ("bank_account_full", "BANK_ACCOUNT", "", rf"(?:普通|当座){WS}*[0-9]{{7}}(?:[ 　]+[゠-ヿー\-・]{{2,}})?|[0-9]{{7}}[ 　]+[゠-ヿー\-・]{{2,}}"),
    ("amount_jpy", "AMOUNT_JPY", rf"(?m:^|{WS[:-1]}「『])(?:月額|金額|額|振込)?{WS}*", "[0-9,]+円(?:（[^）]*）)?"),
    ("label_party", "COMPANY_NAME_HINT", "", rf"(?:甲|乙)[:：]{WS}*[^\n\r]+"),
    ("label_daihyo_long", "PERSON_NAME_HINT", "", rf"代表取締役{WS}+[^\n\r]{{1,120}}"),
    ("label_daihyo_short", "PERSON_NAME_HINT", "", rf"(?:代表者|代表){WS}+[^\n\r]{{1,120}}"),
    ("label_tanto_line", "PERSON_NAME_HINT", "", rf"(?:甲側|乙側)?担当[:：]{WS}*[^\n\r]+"),
    ("label_shimei", "PERSON_NAME_HINT", "", rf"氏名[:：]{WS}*[^\n\r]+"),
    ("label_company_name", "COMPANY_NAME_HINT", "", rf"会社名[:：]{WS}*[^\n\r]+"),
)
#: Lines that hold each rule's form, close misses and overlaps; {} is the document's id.
NOTICE = """
氏名: {} 殿
会社名： 株式会社{} 03-1234-5678
甲: {} 社 a{}@one.example.com
甲側担当：{}　乙側担当: {}
代表取締役 代表 {}
代表者  {}
金額 1,{}円（税込） 20,000円 月額 5円 7円8円
「300円」 額　{}円
普通 1234567 タナカ・タ 7654321 ヤマダ
〒100-0001 100-00012 090-12XX-5678 1100-0002-30004
123456789012 1234567890123 x210987654321y {}000000000000
b{}@two.example.com,c@three.example.org"""


def mask_sql(rows: str) -> str:
    """Masked text, spans and hits of rows (doc_id, text): matches are set between marks, which give their places."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{rule}' AS id, '{kind}' AS kind, string_split(regexp_replace(text, '({pre})({body})', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS p FROM t" for k, (rule, kind, pre, body) in enumerate(RE2_RULES)
    )
    return rf"""WITH t AS MATERIALIZED ({rows}), found AS ({found}),
    spans AS (SELECT doc_id, k, id, kind, unnest(list_transform(range(2, len(p), 2), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT), 'n': length(p[i])}})) AS x FROM found),
    ordered AS (SELECT doc_id, list([{{'s': x.s, 'e': x.s + x.n, 'id': id, 'kind': kind}}] ORDER BY x.s, x.n DESC, k) AS l FROM spans WHERE id <> 'mynumber_12' OR x.n = 12 GROUP BY doc_id),
    chosen AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN a[-1].e <= b[1].s THEN list_concat(a, b) ELSE a END) AS c FROM ordered),
    m AS (SELECT t.doc_id, text, coalesce(c, []) AS c, list_transform(coalesce(c, []), lambda x: x.id) AS ids FROM t LEFT JOIN chosen ON chosen.doc_id = t.doc_id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat(array_to_string(list_transform(range(1, len(c) + 1), lambda i: concat(substr(text, coalesce(c[i - 1].e, 0) + 1, c[i].s - coalesce(c[i - 1].e, 0)), '[REDACTED:', c[i].kind, ']')), ''), substr(text, coalesce(c[-1].e, 0) + 1)) END AS "maskedContent",
        CAST(len(c) AS INTEGER) AS spans, concat('{{', array_to_string(list_transform(list_filter(range(1, len(ids) + 1), lambda i: list_position(ids, ids[i]) = i), lambda i: concat('"', ids[i], '":', len(list_filter(ids, lambda x: x = ids[i])))), ','), '}}') AS "ruleHits" FROM m"""


def _masked(docs: DataFrame) -> DataFrame:
    got = masking.simple_rule(docs.select("doc_id", "text"))
    return got.select("doc_id", "maskedContent", F.size("maskedSpans").alias("spans"), F.to_json("ruleHits").alias("ruleHits"))


@query(mask_sql("SELECT doc_id, text FROM documents"))
def mask_all_rules(spark: SparkSession, d: str) -> DataFrame:
    return _masked(table(spark, d, "documents"))


@query(mask_sql("SELECT doc_id, concat(text, replace('" + NOTICE + "', '{}', CAST(doc_id AS VARCHAR))) AS text FROM documents"))
def mask_notices(spark: SparkSession, d: str) -> DataFrame:
    """Documents with lines of every rule behind them, filled in with their ids."""
    docs = table(spark, d, "documents")
    return _masked(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.replace(F.lit(NOTICE), F.lit("{}"), F.col("doc_id").cast("string")))))


@query(DOCS + f"""SELECT id, "docId", sensitivity, sha256(concat('KNOWLEDGE_CHUNK_SOURCE_HASH_V1', chr(0), 'paragraph', chr(0), text)) AS "sourceHash", length(body) AS chars
    FROM (SELECT *, concat("docId", ':text:paragraph') AS id, {sql_trim('text')} AS body FROM lab) WHERE body <> ''""")
def plain_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.plain_text_chunks(labelled(spark, d)).select("id", "docId", "sensitivity", "sourceHash", F.length("text").cast("bigint").alias("chars"))


@query(r"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS chars FROM (
    SELECT doc_id, CASE WHEN len(blank) > 1 THEN blank WHEN len(lines) > 0 THEN lines ELSE [text] END AS p FROM (
        SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: """ + sql_trim("x") + r"""), lambda x: x <> '') AS blank,
            list_filter(list_transform(string_split(text, chr(10)), lambda x: """ + sql_trim("x") + r"""), lambda x: x <> '') AS lines FROM documents))""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "documents").select("doc_id", chunking.paragraphs(F.col("text")).alias("p"))
    return got.select("doc_id", F.size("p").cast("bigint").alias("n"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("chars"))


def _as_layout(spark: SparkSession, d: str) -> DataFrame:
    """Documents as layouts of one page with one block."""
    docs = labelled(spark, d)
    block = F.struct(F.lit("b1").alias("blockId"), F.lit("paragraph").alias("kind"), "text", F.struct(F.lit(1).alias("pageNumber"), F.lit(None).cast("int").alias("slideNumber"), F.lit(None).cast("int").alias("tableIndex"), F.lit(None).cast("int").alias("rowIndex"), F.lit(None).cast("array<double>").alias("bbox")).alias("locator"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return docs.select("docId", F.lit("official-doc-pdf").alias("sourceSubtype"), F.col("text").alias("extractorInput"), "sensitivity", "aiUsePolicy", F.array(F.struct(F.lit(1).alias("pageNumber"), F.array(block).alias("blocks"))).alias("pages"))


@query()
def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    got = chunking.ir_chunks(_as_layout(spark, d), most=6000)
    return got.select("id", "docId", "part", F.length("text").alias("chars"), F.element_at("extractionWarnings", -1).alias("note"), "sourceHash")


@query(DOCS + """SELECT "docId", path, message FROM (
    SELECT "docId", 'maskedText' AS path, 'When aiUsePolicy is requires_masking, maskedText must be present and non-empty.' AS message FROM lab WHERE "aiUsePolicy" = 'requires_masking'
    UNION ALL SELECT "docId", 'parentDocument.status', 'parentDocument.status must be one of curated, ai_safe, restricted, or blocked.' FROM lab WHERE status = 'masking')""")
def chunk_invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = labelled(spark, d)
    given = docs.withColumns({"parentStatus": F.col("status"), "extractorInput": F.col("text")})
    met = chunking.plain_text_chunks(given, keep=("parentStatus", "extractorInput")).withColumns({"maskedText": F.lit(None).cast("string"), "sensitivityReason": F.lit(None).cast("string")})
    size = text.json_bytes(F.struct("id", "docId", "locator", "text", "sensitivity", "aiUsePolicy", "sourceHash"))
    return violations(met, "docId", chunk_violations(met, F.col("docId"), F.col("parentStatus"), F.col("extractorInput"), size))


@query("""SELECT sha AS "contentSha256", min(doc_id) AS id, count(*) AS n FROM (SELECT doc_id, sha256(text) AS sha FROM documents) GROUP BY sha""")
def dedupe_by_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.content_hash(F.col("text")).alias("contentSha256"))
    return compare.one_of(docs, "contentSha256").select("contentSha256", "id", "n")


@query("""WITH old AS (SELECT source, sha256(text) AS sha, doc_id FROM documents SEMI JOIN labels USING (doc_id)), one AS (SELECT source, min(doc_id) AS id, arg_min(sha, doc_id) AS sha FROM old GROUP BY source)
    SELECT d.doc_id, one.id AS "existingId", CASE WHEN one.id IS NULL THEN 'create' WHEN one.sha = sha256(d.text) THEN 'skip' ELSE 'overwrite' END AS action FROM documents d LEFT JOIN one USING (source)""")
def import_action(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("fileId"), text.content_hash(F.col("text")).alias("contentSha256"))
    stored = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "fileId", "contentSha256", F.lit("google_workspace").alias("sourceKind"), F.lit(True).alias("rehydratable"))
    return compare.import_actions(docs, stored).select("doc_id", "existingId", "action")


def _conversation_measures(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, turns as pages; every other assistant turn counts as a table."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), F.col("turn").alias("pageOrd"), (F.col("turn") + 1).alias("pageNumber"), "role", "text")
    kind = F.when((F.col("role") == "assistant") & (F.col("pageOrd") % 4 == 1), "table").otherwise("paragraph")
    at = F.struct(F.col("pageNumber").cast("int").alias("pageNumber"), F.when(F.col("pageOrd") % 4 == 1, 0).alias("tableIndex"))
    blocks = turns.where("role <> 'system'").select("docId", "pageOrd", "pageNumber", kind.alias("kind"), "text", at.alias("locator"))
    cover = evaluation.coverage(blocks, turns.select("docId", "pageOrd", "pageNumber", F.lit("scan-pdf").alias("sourceSubtype")))
    return cover.join(evaluation.readiness(turns), "docId")


MEASURES = """WITH turns AS (SELECT conv_id AS "docId", turn, role, text, length(""" + sql_trim("text") + """) AS chars FROM conversations), m AS (
    SELECT "docId", count(*) AS "chunkCount", avg(length(text)) AS "averageChunkLength", count_if(chars = 0) AS "emptyChunks",
        CAST(count_if(role <> 'system' AND chars > 0) AS DOUBLE) / count(*) AS "pageCoverage", count_if(role = 'assistant' AND turn % 4 = 1) AS "tableCandidates",
        count_if(role = 'system' OR chars < 50) + CASE WHEN count_if(role <> 'system' AND chars > 0) = 0 THEN 1 ELSE 0 END AS warnings,
        bool_or(role <> 'system') AS "hasPageLocators", coalesce(bool_or(role <> 'system' AND turn % 4 = 1), false) AS "hasTableLocators" FROM turns GROUP BY "docId"
), ax AS (
    SELECT *, CASE WHEN "pageCoverage" >= 1 THEN 'pass' WHEN "pageCoverage" >= 0.75 THEN 'warn' ELSE 'fail' END AS coverage,
        CASE WHEN NOT "hasPageLocators" THEN 'fail' WHEN NOT "hasTableLocators" THEN 'warn' ELSE 'pass' END AS "locatorQuality",
        CASE WHEN "emptyChunks" > 0 THEN 'fail' ELSE 'pass' END AS "contextPackageReadiness" FROM m
), ov AS (SELECT *, CASE WHEN 'fail' IN (coverage, "locatorQuality", "contextPackageReadiness") THEN 'warn' ELSE 'pass' END AS status FROM ax) """


@query(MEASURES + """SELECT "docId", round("pageCoverage", 6) AS "pageCoverage", "tableCandidates", warnings, "hasPageLocators", "hasTableLocators", "chunkCount", round("averageChunkLength", 6) AS "averageChunkLength", "emptyChunks" FROM m""", whole=("tableCandidates", "warnings", "emptyChunks"))
def conversation_ir_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = _conversation_measures(spark, d)
    return m.select("docId", F.round("pageCoverage", 6).alias("pageCoverage"), "tableCandidates", F.size("textDensityWarnings").cast("bigint").alias("warnings"), "hasPageLocators", "hasTableLocators", "chunkCount", F.round("averageChunkLength", 6).alias("averageChunkLength"), "emptyChunks")


@query(MEASURES + """SELECT "docId", coverage, "locatorQuality", "contextPackageReadiness", status, concat_ws('|', CASE WHEN "contextPackageReadiness" = 'fail' THEN 'context_package_readiness: fail (downgraded to warn)' END,
    CASE WHEN coverage = 'fail' THEN 'coverage: fail (downgraded to warn)' END, CASE WHEN "locatorQuality" = 'fail' THEN 'locator_quality: fail (downgraded to warn)' END) AS reasons FROM ov""")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = evaluation.evaluated(_conversation_measures(spark, d), "heuristic", F.lit("scan-pdf"))
    return e.select("docId", "coverage", "locatorQuality", "contextPackageReadiness", "status", F.array_join("reasons", "|").alias("reasons"))


@query(MEASURES + "SELECT count_if(status = 'pass') AS pass, count_if(status = 'warn') AS warn, count_if(status = 'fail') AS fail FROM ov", whole=("pass", "warn", "fail"))
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.status_summary(evaluation.evaluated(_conversation_measures(spark, d), "heuristic", F.lit("scan-pdf")))


@query(MEASURES + """SELECT axis, count_if(s = 'pass') AS pass, count_if(s = 'warn') AS warn, count_if(s = 'fail') AS fail FROM (
    SELECT 'coverage' AS axis, coverage AS s FROM ov UNION ALL SELECT 'locator_quality', "locatorQuality" FROM ov UNION ALL SELECT 'safety_readiness', 'pass' FROM ov) GROUP BY axis""", whole=("pass", "warn", "fail"))
def axis_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.axis_summary(evaluation.evaluated(_conversation_measures(spark, d), "heuristic", F.lit("scan-pdf")))


@query(r"""WITH l AS (SELECT doc_id, text, regexp_replace(text, '[\s]+', '', 'g') AS corpus, string_split(text, chr(10))[1] AS line FROM documents),
    f AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id - 1, line FROM l), m AS (SELECT doc_id, contains(corpus, regexp_replace(f.line, '[\s]+', '', 'g')) AS found FROM f JOIN l USING (doc_id))
    SELECT doc_id AS "docId", round(CAST(count_if(found) AS DOUBLE) / count(*), 6) AS "keyFieldRecall", count_if(NOT found) AS missing FROM m GROUP BY doc_id""", whole=("missing",))
def semantic_retention(spark: SparkSession, d: str) -> DataFrame:
    """All documents, their lines as chunks; the fields expected of one are its own first line and that of the next document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("docId"), "text")
    chunks = docs.select("docId", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    first = chunks.where("ord = 0").select("docId", "text")
    fields = first.unionByName(first.withColumn("docId", F.col("docId") - 1)).groupBy("docId").agg(F.collect_list("text").alias("expectedFields"))
    got = evaluation.retention(chunks, fields.join(docs.select("docId"), "docId", "left_semi"))
    return got.select("docId", F.round("keyFieldRecall", 6).alias("keyFieldRecall"), F.size("missingExpectedFields").cast("bigint").alias("missing"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), F.col("turn").alias("ord"), "text")
    return evaluation.chunk_ranges(turns)


RANGES = """WITH r AS (SELECT conv_id AS "docId", turn AS ord, text, CAST(coalesce(sum(length(text) + 40) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM conversations) """


@query(RANGES + """SELECT "docId", ord, "start", "start" + length(text) AS "end" FROM r""")
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d).select("docId", "ord", "start", "end")


@query(RANGES + """, s AS (SELECT conv_id AS "docId", turn * 100 AS "start", turn * 100 + 30 AS "end" FROM conversations),
    j AS (SELECT s."docId", r.ord FROM s LEFT JOIN r ON s."docId" = r."docId" AND s."start" >= r."start" AND s."end" <= r."start" + length(r.text))
    SELECT t."docId", coalesce(u.bad, 0) AS "unmaskablePiiFindings", round(CAST(coalesce(u.good, 0) AS DOUBLE) / t.n, 6) AS "maskableChunkRate" FROM (SELECT "docId", count(*) AS n FROM r GROUP BY 1) t
    LEFT JOIN (SELECT "docId", count_if(ord IS NULL) AS bad, count(DISTINCT ord) AS good FROM j GROUP BY 1) u USING ("docId")""", whole=("unmaskablePiiFindings",))
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    r = _ranges(spark, d).withColumns({"structureType": F.lit("paragraph"), "locator": F.lit("paragraph")})
    spans = table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + 30).alias("end"))
    return evaluation.maskability(r, spans).withColumn("maskableChunkRate", F.round("maskableChunkRate", 6))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') OR c_nationkey % 2 = 0 THEN 'Confidential' ELSE 'Internal' END AS sensitivity, CASE c_mktsegment WHEN 'BUILDING' THEN '列ヘッダが電話番号情報を示すため' WHEN 'AUTOMOBILE' THEN '列ヘッダが個別金額/単価/報酬を示すため'
    ELSE CASE WHEN c_nationkey % 2 = 0 THEN '列ヘッダが住所情報を示すため' END END AS reason FROM customer""")
def column_rule_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a table of one row, whose columns its segment and nation decide."""
    more = F.when(F.col("c_mktsegment") == "BUILDING", "Phone").when(F.col("c_mktsegment") == "AUTOMOBILE", "unit price").when(F.col("c_nationkey") % 2 == 0, "Address").otherwise("remarks")
    body = F.concat(F.lit("| id | "), more, F.lit(" |\n| --- | :---: |\n| "), F.col("c_custkey").cast("string"), F.lit(" | "), F.regexp_replace("c_name", r"\|", " "), F.lit(" |"))
    chunks = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), body.alias("text"), F.lit("Internal").alias("sensitivity"), F.lit("direct").alias("aiUsePolicy"))
    return columns.promote(chunks).select("id", "sensitivity", F.col("sensitivityReason").cast("string").alias("reason"))


@query("""SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region""")
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: F.array(r["r_regionkey"].cast("string"), r["r_name"])).alias("rows"))
    return rows.select(text.markdown_table(F.concat(F.array(F.array(F.lit("r_regionkey"), F.lit("r_name"))), "rows")).alias("markdown"))


@query("""SELECT user_id AS "docId", event_id AS "evalId", event_type AS stage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def latest_eval_per_doc(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("docId"), F.col("event_id").alias("evalId"), F.col("event_type").alias("stage"), "ts")
    return packages.latest(e, "docId", F.desc("ts"), F.col("evalId")).drop("ts")


@query("""SELECT e.event_id AS "evalId", CASE WHEN o.event_id IS NOT NULL THEN 'already exists' WHEN c.c_custkey IS NULL THEN 'parent not found' END AS error
    FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'purchase') o ON o.event_id = e.event_id LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def append_only_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("evalId"), F.col("user_id").alias("docId"), "event_type")
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return compare.insertable(e, e.where("event_type = 'purchase'").select("evalId"), "evalId", parents).select("evalId", "error")


@query(r"""SELECT item_id, 'pb_sha256_' || sha256('{"version":1,"purpose":"' || replace(lower(regexp_replace(""" + sql_trim("text") + r""", '\s+', ' ', 'g')), '"', '\"') || '","tenantId":"tenant-a","timestamp":"2024-01-01T00:00:00.000Z"}') AS binding FROM benchmark""")
def purpose_binding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.purpose_binding(F.col("text"), F.lit("tenant-a"), F.lit("2024-01-01T00:00:00.000Z")).alias("binding"))


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 5 = 0 THEN false WHEN n_nationkey % 3 = c_custkey % 3 THEN true ELSE n_nationkey % 2 = 0 END AS enabled FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def feature_flag_eval(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    flags = table(spark, d, "nation").select(n, (n % 2 == 0).alias("defaultEnabled"), F.array((n % 3).cast("string")).alias("enabledTenants"), F.when(n % 5 == 0, "2020-01-01T00:00:00Z").otherwise("2999-01-01T00:00:00Z").alias("expiresAt"))
    met = table(spark, d, "customer").join(flags, F.col("c_nationkey") == n)
    on = policy.flag_enabled(F.col("defaultEnabled"), F.col("enabledTenants"), F.col("expiresAt"), (F.col("c_custkey") % 3).cast("string"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return met.select("c_custkey", on.alias("enabled"))


@query("""WITH e AS (SELECT user_id, max(CAST(ts AS DATE)) AS latest FROM events GROUP BY 1), o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS saved FROM orders GROUP BY 1)
    SELECT o_custkey AS id, CASE WHEN saved IS NULL THEN 'saved_time_missing' WHEN latest IS NULL THEN 'latest_time_missing' WHEN latest > saved THEN 'stale' ELSE 'fresh' END AS code FROM o LEFT JOIN e ON user_id = o_custkey""")
def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).cast("string").alias("latest"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).cast("string").alias("saved"))
    met = o.join(e, F.col("user_id") == F.col("o_custkey"), "left")
    return met.select(F.col("o_custkey").alias("id"), policy.freshness(F.lit(True), F.lit(True), F.lit(200), F.col("latest"), F.col("saved")).alias("code"))


@query("SELECT l_orderkey AS \"docId\", count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(parents, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("docId")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("""SELECT "docId", field, place FROM (SELECT *, row_number() OVER (PARTITION BY "docId" ORDER BY ord) AS place FROM (
    SELECT conv_id AS "docId", """ + sql_trim("text") + """ AS field, min(turn) AS ord FROM conversations GROUP BY 1, 2) WHERE length(field) >= 4) WHERE place <= 12""")
def top_first_n_distinct_fields(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), F.col("turn").alias("ord"), "text")
    return evaluation.field_candidates(chunks).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT event_id, round(value * 1000 / 1000000.0 * 0.3 + value * 100 / 1000000.0 * 2.5, 9) AS usd FROM events")
def ocr_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(policy.token_cost(F.lit("gemini-2.5-flash"), F.col("value") * 1000, F.col("value") * 100), 9).alias("usd"))


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    docs = labelled(spark, d)
    return docs.select(
        F.col("docId").alias("id"), F.concat(F.lit("doc-"), "docId", F.lit(".txt")).alias("fileName"), "status", "sensitivity", "aiUsePolicy", F.lit("rationale").alias("rationale"), F.lit("その他").alias("documentType"),
        F.lit(None).cast("string").alias("sensitivityReason"), F.lit(None).cast("string").alias("contextPackageBodyLoadError"), (F.col("status") == "masking").alias("evaluated"), F.when(F.col("lang") != "es", F.col("text")).alias("aiSafeContent"),
    )


@query(DOCS + """SELECT bucket, reason, count(*) AS n FROM (SELECT CASE WHEN "aiUsePolicy" = 'blocked' OR status = 'masking' OR lang = 'es' THEN 'humanReview' ELSE 'included' END AS bucket,
    CASE WHEN "aiUsePolicy" = 'blocked' THEN 'Restricted after Masker residual risk — not for downstream AI' WHEN status = 'masking' THEN 'Document status masking is not ready for Context Package export'
        WHEN lang = 'es' THEN 'Body not available for Context Package export' ELSE 'rationale' END AS reason FROM lab) GROUP BY ALL""")
def document_package_partition(spark: SparkSession, d: str) -> DataFrame:
    return packages.document_package(_inventory(spark, d)).groupBy("bucket", "reason").agg(F.count("*").alias("n"))


@query(DOCS + """, rows AS (
    SELECT CASE WHEN "aiUsePolicy" = 'requires_masking' THEN 'humanReview' ELSE 'included' END AS bucket, 'chunk' AS made FROM lab WHERE sensitivity <> 'Public' AND status <> 'blocked'
    UNION ALL SELECT CASE WHEN "aiUsePolicy" = 'blocked' OR status = 'masking' OR lang = 'es' THEN 'humanReview' ELSE 'included' END, 'document' FROM lab WHERE sensitivity = 'Public')
    SELECT bucket, count(*) AS n FROM rows GROUP BY bucket""")
def chunk_package_partition(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.plain_text_chunks(labelled(spark, d).where("sensitivity <> 'Public'")).withColumn("maskedText", F.lit(None).cast("string"))
    return packages.chunk_package(_inventory(spark, d), chunks).groupBy("bucket").agg(F.count("*").alias("n"))


@query()
def package_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The last updated 100 documents' chunks, all that pass the gate selected."""
    docs = _inventory(spark, d).withColumn("updatedAt", F.col("id").cast("bigint"))
    chunks = chunking.plain_text_chunks(labelled(spark, d)).withColumn("maskedText", F.lit(None).cast("string"))
    every = lambda c: c.select("docId", F.col("id").alias("chunkId"), F.lit("included").alias("verdict"), F.lit("fits the purpose").alias("rationale"), F.lit(None).cast("string").alias("reason"))
    rows = packages.purpose_query(docs, chunks, every).withColumn("ord", F.col("docId").cast("bigint"))
    return packages.rendered(rows, "review", "2024/01/01 09:00 JST", 100)


@query(DOCS + """SELECT status, count(*) AS n FROM (SELECT CASE WHEN status <> 'masking' THEN status WHEN regexp_matches(text, '[0-9]') THEN 'restricted' ELSE 'ai_safe' END AS status FROM lab) GROUP BY status""")
def upload_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    files = labelled(spark, d).select(F.col("docId").alias("id"), F.concat("docId", F.lit(".txt")).alias("fileName"), F.lit("text/plain").alias("contentType"), F.col("text").cast("binary").alias("content"), F.col("sensitivity").alias("s"), "text")
    docs = lifecycle.initial(files, now, keep=("s", "text")).drop("content")
    curate = lambda x: x.withColumns({"c_sensitivity": F.col("s"), "c_rationale": F.lit("by label")})
    hit = F.col("text").rlike("[0-9]")
    risk = lambda x: x.withColumns({"detected": hit, "recommendedSensitivity": F.when(hit, "Restricted").otherwise("Confidential"), "reasons": F.when(hit, F.array(F.lit("digits"))).otherwise(F.array().cast("array<string>")), "riskRationale": F.lit("digits")})
    return lifecycle.text_lifecycle(docs, curate, risk, now).groupBy("status").agg(F.count("*").alias("n"))


@query(DOCS + """SELECT "docId" AS id, path FROM (
    SELECT "docId", 'status' AS path FROM lab WHERE status = 'blocked' AND lang = 'de' UNION ALL
    SELECT "docId", 'sourceKind' FROM lab WHERE lang = 'fr' UNION ALL SELECT "docId", 'aiSafeStoragePath' FROM lab WHERE lang = 'es')""")
def document_invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = labelled(spark, d)
    none = lambda t: F.lit(None).cast(t)
    masker = none("struct<decision:string,sourceContentHash:string>")
    given = docs.select(
        F.col("docId").alias("id"), "status", "sensitivity", "aiUsePolicy", F.lit("curator").alias("sensitivitySource"), none("string").alias("originalCuratorSensitivity"), none("string").alias("sensitivityReason"), F.lit("h").alias("contentSha256"),
        F.lit(False).alias("maskingPending"), F.struct(F.when((F.col("status") == "blocked") & (F.col("lang") == "de"), "direct").otherwise(F.col("aiUsePolicy")).alias("aiUsePolicy")).alias("curator"), masker.alias("masker"),
        F.when(F.col("lang") == "es", "masked/x").alias("aiSafeStoragePath"), F.lit("upload").alias("sourceKind"), F.when(F.col("lang") == "fr", F.struct(F.lit("google_drive").alias("provider"))).alias("externalSource"),
    )
    return violations(given, "id", document_violations(given)).select("id", "path")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9.-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS tenant,
    left(replace(replace(url, '/', '_'), '\', '_'), 200) AS "safeName" FROM pages""")
def names_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.tenant_normalized(F.col("url")).alias("tenant"), text.safe_file_name(F.col("url")).alias("safeName"))


@query("""SELECT o_orderkey, CASE WHEN n > 702 THEN chr(CAST(65 + ((((n - 1) // 26) - 1) // 26 - 1) % 26 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, n AS number
    FROM (SELECT o_orderkey, o_orderkey % 16384 + 1 AS n FROM orders)""")
def excel_columns(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", text.excel_column(F.col("o_orderkey") % 16384 + 1).alias("letters"))
    return o.withColumn("number", text.column_number(F.col("letters")))


@query("""SELECT event_id, to_base(epoch_us(ts) // 1000, 36, 9) AS head FROM events""")
def sortable_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", F.upper(F.substring(text.sortable_id(F.col("ms"), F.lit("0" * 16)), 1, 9)).alias("head"))


@query("""SELECT c_custkey, CAST(CASE WHEN r <= 1 THEN 0 ELSE 11 - r END AS INTEGER) AS digit FROM (SELECT c_custkey, list_sum(list_transform(range(0, 11), lambda k: CAST(substr(s, 11 - k, 1) AS INTEGER) * CASE WHEN k < 6 THEN k + 2 ELSE k - 4 END)) % 11 AS r
    FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0') AS s FROM customer))""")
def my_number_digits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "0").alias("s"))
    return c.select("c_custkey", text.my_number_check_digit(F.col("s")).alias("digit"))


@query("""SELECT "docId", "chunkId", message FROM (
    SELECT l_orderkey AS "docId", l_partkey AS "chunkId", 'unknown reference' AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
    UNION ALL SELECT l_orderkey, l_partkey, 'repeated reference' FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""")
def reference_violations(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("docId"), F.col("l_partkey").alias("chunkId"), F.lit("included").alias("verdict"))
    # parts are far fewer than references to them, so a partition's share of them makes the hash table; nothing is sorted
    good = refs.join(table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("chunkId")).hint("shuffle_hash"), "chunkId", "left_semi")
    return packages.reference_violations(refs, good, rows=2 * refs.count())


@query("""SELECT l_orderkey AS "docId", CAST(l_linenumber AS BIGINT) AS id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2) AND l_linenumber > 2""")
def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("docId"), F.col("l_linenumber").cast("bigint").alias("id"))
    return compare.stale(rows, rows.where("id <= 2"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.s AS score_left, l.s AS score_right, d.s IS DISTINCT FROM l.s AS score_differs FROM (SELECT doc_id, n_chars % 2 AS s FROM documents) d FULL OUTER JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS s FROM labels) l ON d.doc_id = l.doc_id""")
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("score"))
    b = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("score"))
    return compare.paired(a, b, "doc_id", ["score"])


@query("""SELECT conv_id AS "docId", CAST(count(*) AS BIGINT) AS pages, CAST(sum(CASE WHEN n = 0 THEN 0 ELSE 1 END) AS BIGINT) AS filled FROM (SELECT conv_id, turn, length(""" + sql_trim("text") + """) AS n FROM conversations) GROUP BY 1""")
def layout_assembly(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), (F.col("turn") + 1).cast("int").alias("page"), "text", F.array().cast("array<array<array<string>>>").alias("tables"))
    got = layouts.text_layer(turns)
    return got.select("docId", F.size("pages").cast("bigint").alias("pages"), F.size(F.filter("pages", lambda p: F.size(p["blocks"]) > 0)).cast("bigint").alias("filled"))


@query("""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS "start", event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    return e.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT doc_id, CAST(strlen('{"text":' || to_json(text) || '}') AS BIGINT) AS bytes FROM documents""")
def payload_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.json_bytes(F.struct("text")).cast("bigint").alias("bytes"))


@query(DOCS + """SELECT status, CASE WHEN status = 'masking' THEN 'partial' ELSE 'success' END AS result, count(*) AS n FROM lab GROUP BY ALL""")
def audit_results(spark: SparkSession, d: str) -> DataFrame:
    docs = labelled(spark, d).withColumn("result", policy.audit_result(F.when(F.col("status") == "masking", "fail").otherwise("pass")))
    return docs.groupBy("status", "result").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'upload' END AS \"sourceKind\", CAST(2 AS INTEGER) AS \"schemaVersion\" FROM orders")
def schema_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("sourceKind"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("schemaVersion"))
    return compare.migrated(docs)


@query("SELECT user_id AS \"docId\", sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 1 AS conflict FROM events GROUP BY 1")
def one_flag_only(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "events").select(F.col("user_id").alias("docId"), (F.col("event_type") == "purchase").cast("int").alias("on"))
    return flags.groupBy("docId").agg((F.sum("on") > 1).alias("conflict"))


@query("SELECT conv_id, CAST(list_position(list(turn ORDER BY turn), max(turn)) AS BIGINT) AS last_place, count(*) AS n FROM conversations GROUP BY 1")
def ordinal_index(spark: SparkSession, d: str) -> DataFrame:
    placed = evaluation.ordinals(table(spark, d, "conversations"), "conv_id", F.asc("turn"))
    return placed.groupBy("conv_id").agg(F.max("ordinal").cast("bigint").alias("last_place"), F.count("*").alias("n"))


@query("SELECT count(*) AS total, count_if(quality = 1) AS passed, round(CAST(count_if(quality = 1) AS DOUBLE) / count(*), 6) AS rate FROM labels", whole=("passed",))
def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    got = reports.pass_rate(table(spark, d, "labels").select((F.col("quality") == 1).alias("passed")))
    return got.withColumn("rate", F.round("rate", 6))


@query("SELECT conv_id AS \"docId\", CAST(count(*) AS BIGINT) AS total, CAST(count_if(role <> 'assistant') AS BIGINT) AS maskable, CAST(count_if(role = 'assistant') AS BIGINT) AS unmaskable, count_if(role <> 'assistant') = 0 AS all_unmaskable FROM conversations GROUP BY 1")
def finding_split(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "unmaskable").otherwise("maskable")
    got = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("docId")).agg(F.collect_list(F.struct(kind.alias("maskability"))).alias("f"))
    return got.select("docId", reports.finding_split(F.col("f")).alias("x")).select("docId", "x.*")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS preview FROM documents")
def preview_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", reports.preview_lines(F.col("text"), 3).alias("preview"))


@query("""SELECT conv_id AS "docId", round(avg(CASE WHEN """ + sql_trim("coalesce(text, '')") + """ <> '' THEN 1.0 ELSE 0.0 END), 6) AS "maskableChunkRate" FROM conversations GROUP BY 1""")
def non_empty_rate(spark: SparkSession, d: str) -> DataFrame:
    got = reports.non_empty_rate(table(spark, d, "conversations").select(F.col("conv_id").alias("docId"), "text"))
    return got.withColumn("maskableChunkRate", F.round("maskableChunkRate", 6))


@query(DOCS + """SELECT sensitivity, lang, count(*) AS n FROM lab WHERE lang <> 'en' AND "aiUsePolicy" <> 'direct' GROUP BY ALL""")
def classifier_violations(spark: SparkSession, d: str) -> DataFrame:
    given = labelled(spark, d).withColumn("aiUsePolicy", F.when(F.col("lang") == "en", F.col("aiUsePolicy")).otherwise("direct"))
    return given.where(policy.label_violation(F.col("sensitivity"), F.col("aiUsePolicy")).isNotNull()).groupBy("sensitivity", "lang").agg(F.count("*").alias("n"))


@query(DOCS + """SELECT "docId", CASE WHEN status = 'masking' THEN false WHEN lang = 'fr' THEN false ELSE true END AS whole FROM lab""")
def rehydration(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    whole = policy.rehydratable(F.col("status"), F.when(F.col("lang") != "fr", F.lit("curator")), none, none, none, none)
    return labelled(spark, d).select("docId", whole.alias("whole"))


@query(DOCS + """SELECT lang AS "docId", count_if(status = 'masking') = 0 AS passed, count_if(status = 'masking') AS errors, 'chunk[' || min(CASE WHEN status = 'masking' THEN doc_id END) || '] invariant failed: not terminal' AS "firstError", NULL::BIGINT AS ord, NULL::VARCHAR AS message FROM lab GROUP BY 1
    UNION ALL SELECT lang, false, NULL, NULL, doc_id, 'chunk[' || doc_id || '] invariant failed: not terminal' FROM lab WHERE status = 'masking'""", whole=("errors",))
def schema_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select(F.col("lang").alias("docId"), F.col("doc_id").alias("ord"), "status")
    broken = F.filter(F.array(F.when(F.col("status") == "masking", F.struct(F.lit("status").alias("path"), F.lit("not terminal").alias("message")))), lambda x: x.isNotNull())
    return reports.validity_report(rows, broken).select("docId", "passed", "errors", "firstError", "ord", "message")


@query(MEASURES + """, e AS (SELECT *, list_filter([CASE WHEN "contextPackageReadiness" = 'fail' THEN 'context_package_readiness: fail (downgraded to warn)' END, CASE WHEN coverage = 'fail' THEN 'coverage: fail (downgraded to warn)' END,
        CASE WHEN "locatorQuality" = 'fail' THEN 'locator_quality: fail (downgraded to warn)' END, CASE WHEN coverage = 'warn' THEN 'coverage: warn' END, CASE WHEN "locatorQuality" = 'warn' THEN 'locator_quality: warn' END], lambda x: contains(x, 'downgraded')) AS reasons FROM ov),
    n AS (SELECT count_if(status = 'pass') AS p, count_if(status = 'warn') AS w, count_if(status = 'fail') AS f, count_if(coverage = 'pass') AS cp, count_if(coverage = 'warn') AS cw, count_if(coverage = 'fail') AS cf,
        count_if("locatorQuality" = 'pass') AS lp, count_if("locatorQuality" = 'warn') AS lw, count_if("locatorQuality" = 'fail') AS lf, count(*) AS every FROM e)
    SELECT CAST(0 AS INTEGER) AS part, NULL AS "docId", format('{{"stage":"heuristic","summary":{{"pass":{},"warn":{},"fail":{}}},"fixtures":[', p, w, f) AS line FROM n
    UNION ALL SELECT 1, "docId", CASE WHEN "docId" > (SELECT min("docId") FROM e) THEN ',' ELSE '' END || to_json({'docId': "docId", 'status': status, 'reasons': reasons}) FROM e
    UNION ALL SELECT 2, NULL, format('],"heuristicAxisSummary":[{{"axis":"coverage","pass":{},"warn":{},"fail":{}}},{{"axis":"locator_quality","pass":{},"warn":{},"fail":{}}},{{"axis":"safety_readiness","pass":{},"warn":0,"fail":0}}]}}', cp, cw, cf, lp, lw, lf, every) FROM n""")
def ci_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.ci_report(evaluation.evaluated(_conversation_measures(spark, d), "heuristic", F.lit("scan-pdf")), "heuristic")
