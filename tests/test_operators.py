import pytest
from pyspark.sql import functions as F

from paperloom.functions import policy
from paperloom.operators import chunking, columns, compare, evaluation, packages, reports
from paperloom.plans import lifecycle
from paperloom.schemas import PAGES


def layout(spark, pages, subtype="official-doc-pdf", text="in"):
    import json

    df = spark.createDataFrame([("d", subtype, text, "Internal", "direct", json.dumps(pages))], "docId string, sourceSubtype string, extractorInput string, sensitivity string, aiUsePolicy string, j string")
    return df.withColumn("pages", F.from_json("j", " ".join(PAGES.split()))).drop("j")


PAGES_GIVEN = [
    {"pageNumber": 1, "blocks": [
        {"blockId": "p1-b1", "kind": "heading", "text": "第1章", "metadata": {"headingLevel": "2"}},
        {"blockId": "p1-t0-r1", "kind": "table", "text": "a\tb", "locator": {"pageNumber": 1, "tableIndex": 0, "rowIndex": 1, "bbox": [0, 0.5, 2, 3]}},
        {"blockId": "n", "kind": "note", "text": "gone"},
        {"blockId": "i", "kind": "image_text", "text": "pic"},
    ]},
    {"pageNumber": 2, "blocks": []},
]


def test_layout_to_chunks(spark):
    got = {r["id"]: r for r in chunking.ir_chunks(layout(spark, PAGES_GIVEN)).collect()}
    assert set(got) == {"d:p1-b1", "d:p1-t0-r1", "d:i"}
    assert got["d:p1-b1"]["structureType"] == "paragraph" and got["d:p1-b1"]["locator"]["paragraphId"] == "p1-b1"
    assert got["d:p1-b1"]["extractionWarnings"] == ["headingLevel=2 (heading demoted to paragraph; KnowledgeChunk has no heading structureType)"]
    assert got["d:p1-t0-r1"]["locator"]["paragraphId"] == "table-0-row-1"
    assert got["d:p1-t0-r1"]["extractionWarnings"] == ["bbox=[0,0.5,2,3] (locator schema has no bbox; preserved as warning)"]
    assert got["d:i"]["locator"]["kind"] == "imageText"
    slides = chunking.ir_chunks(layout(spark, PAGES_GIVEN[:1], "slide-pdf")).where("id = 'd:p1-b1'").first()
    assert slides["locator"]["slide"] == 1 and slides["sourceType"] == "slide" and slides["extractionProvider"] == "slides"


def test_oversize_blocks_are_split(spark):
    text = "\n\n".join(f"para {k} " + "x" * 60 for k in range(12)) + "\n\n" + "é" * 900
    got = chunking.ir_chunks(layout(spark, [{"pageNumber": 1, "blocks": [{"blockId": "b", "kind": "paragraph", "text": text}]}]), most=1000).orderBy("part").collect()
    assert len(got) > 3 and [r["id"] for r in got] == [f"d:b:part-{k}" for k in range(1, len(got) + 1)]
    assert all(r["locator"]["paragraphId"] == f"b:part-{k}" for k, r in enumerate(got, 1)) and len({r["sourceHash"] for r in got}) == len(got)
    assert got[0]["extractionWarnings"][-1] == f"split=1/{len(got)} (exceeded 1000B; paragraph-aligned)"
    assert "".join("".join(r["text"].split()) for r in got) == "".join(text.split())


def test_split_is_greedy_and_never_too_long():
    size = lambda t: len(t.encode())
    for text, room in (("a\n\nb\n\nc", 4), ("one\ntwo\nthree", 5), ("xxxxxxxx", 3), ("ééé", 2), ("short", 100)):
        parts = chunking.split_oversize(text, room, size)
        assert all(size(p) <= room for p in parts) and "".join("".join(p.split()) for p in parts) == "".join(text.split())
    assert chunking.split_oversize("a\n\nb\n\nc", 4, size) == ["a\n\nb", "c"]


def test_segments_and_headings(spark):
    rows = spark.createDataFrame([("第1章 総則\r\n\r\nline one\nline two\n\n1. 目的\n\n（1） x\n\n" + "2. " + "y" * 70,)], "t string")
    got = [(s["kind"], s["headingLevel"]) for s in rows.select(chunking.page_segments(F.col("t"))).first()[0]]
    assert got == [("heading", 1), ("paragraph", None), ("heading", 2), ("heading", 3), ("paragraph", None)]


def test_column_rules(spark):
    rows = [("| 氏名 | 備考 |\n|---|---|", "Internal"), ("| Ｅmail |\n| --- |", "Public"), ("| name | v |\n| --- |", "Internal"), ("no table", "Internal"), ("| 氏名 |\n|---|", "Restricted"), (None, "Internal")]
    df = spark.createDataFrame([(k, t, s, "direct") for k, (t, s) in enumerate(rows)], "k int, text string, sensitivity string, aiUsePolicy string")
    got = {r["k"]: (r["sensitivity"], r["sensitivitySource"]) for r in columns.promote(df).collect()}
    assert got == {0: ("Confidential", "columnRule"), 1: ("Confidential", "columnRule"), 2: ("Internal", None), 3: ("Internal", None), 4: ("Restricted", None), 5: ("Internal", None)}


def test_coverage_warnings(spark):
    pages = [{"pageNumber": 1, "blocks": [{"blockId": "a", "kind": "paragraph", "text": " "}]}, {"pageNumber": 2, "blocks": []}, {"pageNumber": 3, "blocks": [{"blockId": "b", "kind": "table", "text": "short", "locator": {"pageNumber": 3, "tableIndex": 0}}]}]
    docs = layout(spark, pages, "scan-pdf")
    listed = docs.select("docId", "sourceSubtype", F.posexplode("pages").alias("pageOrd", "p")).select("docId", "sourceSubtype", "pageOrd", "p.pageNumber")
    got = evaluation.coverage(chunking.ir_blocks(docs), listed).first()
    assert got["textDensityWarnings"] == ["page 1: all blocks are empty after trim", "page 2: zero OCR blocks (scan-pdf pageCoverage miss)", "page 3: low text density (5 chars across 1 block(s); threshold=50)"]
    assert abs(got["pageCoverage"] - 1 / 3) < 1e-9 and got["tableCandidates"] == 1 and got["hasTableLocators"]


@pytest.mark.parametrize(("stage", "subtype", "changes", "want"), [
    ("health", None, {}, ("pass", [])),
    ("heuristic", None, {"unmaskablePiiFindings": 1}, ("fail", ["safety_readiness: fail"])),
    ("heuristic", "scan-pdf", {"unmaskablePiiFindings": 1}, ("warn", ["safety_readiness: warn"])),
    ("health", None, {"unmaskablePiiFindings": 1, "pageCoverage": 0.0}, ("pass", [])),
    ("heuristic", None, {"pageCoverage": 0.8}, ("pass", [])),
    ("golden", None, {"pageCoverage": 0.7, "hasPageLocators": False}, ("warn", ["coverage: fail (downgraded to warn)", "locator_quality: fail (downgraded to warn)"])),
    ("health", None, {"emptyChunks": 1}, ("warn", ["context_package_readiness: fail (downgraded to warn)"])),
    ("health", None, {"passed": False}, ("fail", ["schema_validity: fail"])),
])
def test_rollup(spark, stage, subtype, changes, want):
    row = {"passed": True, "errors": [], "chunkCount": 1, "emptyChunks": 0, "oversizedChunks": 0, "pageCoverage": 1.0, "hasPageLocators": True, "hasTableLocators": True, "unmaskablePiiFindings": 0, "maskableChunkRate": 1.0} | changes
    df = spark.createDataFrame([tuple(row.values())], "passed boolean, errors array<string>, chunkCount int, emptyChunks int, oversizedChunks int, pageCoverage double, hasPageLocators boolean, hasTableLocators boolean, unmaskablePiiFindings int, maskableChunkRate double")
    got = evaluation.evaluated(df, stage, None if subtype is None else F.lit(subtype)).first()
    assert (got["status"], got["reasons"]) == want


def test_retention(spark):
    chunks = spark.createDataFrame([("d", 1, "ＡＢＣ 株式"), ("d", 2, "会社")], "docId string, ord int, text string")
    expected = spark.createDataFrame([("d", ["ABC", "株 式", "none", " "]), ("e", [])], "docId string, expectedFields array<string>")
    got = {r["docId"]: r for r in evaluation.retention(chunks, expected).collect()}
    assert got["d"]["keyFieldRecall"] == 0.75 and got["d"]["missingExpectedFields"] == ["none"] and got["e"]["keyFieldRecall"] == 1.0


PARENTS = "id string, fileName string, status string, sensitivity string, aiUsePolicy string, rationale string, documentType string, sensitivityReason string, contextPackageBodyLoadError string, evaluated boolean, aiSafeContent string, updatedAt int"


def inventory(spark):
    return spark.createDataFrame([
        ("a", "a.txt", "curated", "Public", "direct", "ok", "メモ", None, None, False, " body ", 5),
        ("b", "b.txt", "blocked", "Restricted", "blocked", "no", "メモ", None, None, False, None, 4),
        ("c", "c.txt", "ai_safe", "Confidential", "requires_masking", "ok", "表", None, None, True, "masked", 3),
        ("e", "e.txt", "curated", "Public", "direct", "ok", "メモ", None, "lost", False, None, 2),
        ("f", "f.txt", "curated", "Public", "direct", "ok", "メモ", None, None, False, " ", 1),
    ], PARENTS)


CHUNKS = "id string, docId string, text string, maskedText string, sensitivity string, aiUsePolicy string, locator struct<kind:string,sheetName:string,range:string>"


def chunks(spark):
    return spark.createDataFrame([
        ("a1", "a", " t ", None, "Public", "direct", ("spreadsheet", "S", "A1:B2")),
        ("a2", "a", " ", None, "Public", "direct", ("paragraph", None, None)),
        ("a3", "a", "x", " ", "Confidential", "requires_masking", ("paragraph", None, None)),
        ("a4", "a", "x", None, "Restricted", "blocked", ("paragraph", None, None)),
        ("b1", "b", "x", None, "Public", "direct", ("paragraph", None, None)),
        ("z1", "z", "x", None, "Public", "direct", ("paragraph", None, None)),
    ], CHUNKS)


def test_document_package(spark):
    got = {r["docId"]: r for r in packages.document_package(inventory(spark)).collect()}
    assert {k: r["bucket"] for k, r in got.items()} == {"a": "included", "b": "humanReview", "c": "included", "e": "humanReview", "f": "humanReview"}
    assert got["a"]["aiSafeContent"] == "body" and got["c"]["aiSafeViaMasking"] and got["e"]["reason"] == "lost" and got["f"]["reason"] == packages.NO_BODY
    assert packages.document_package(inventory(spark), placeholders=True).where("docId = 'f'").first()["bucket"] == "included"


def test_chunk_package(spark):
    got = sorted((r["bucket"], r["fileName"], r["reason"]) for r in packages.chunk_package(inventory(spark), chunks(spark)).where("docId IN ('a', 'b', 'z')").collect())
    assert got == [
        ("humanReview", "a.txt", "Chunk requires masking but maskedText is unavailable"),
        ("humanReview", "a.txt", "Chunk text content is empty or unavailable"),
        ("humanReview", "z1", "Chunk parent document not found for docId=z"),
        ("included", "a.txt (sheet=S, range=A1:B2)", "ok"),
    ]


def every(c):
    return c.select("docId", F.col("id").alias("chunkId"), F.lit("included").alias("verdict"), F.lit("why").alias("rationale"), F.lit(None).cast("string").alias("reason"))


def test_purpose_query_and_rendering(spark):
    rows = packages.purpose_query(inventory(spark), chunks(spark), every, limit=2)
    assert sorted((r["bucket"], r["docId"]) for r in rows.collect()) == [("humanReview", "a"), ("humanReview", "a"), ("included", "a"), ("included", "a"), ("included", "b")]
    text = packages.rendered(rows.withColumn("ord", F.col("fileName")), "P", "now", 2, ["gap"], ["who?"]).first()[0]
    assert "- Included documents: 3\n- Excluded documents: 0\n- Human review required: 2" in text and "- gap\n" in text and "1. who?\n" in text
    assert "## Source: a.txt (sheet=S, range=A1:B2)\n\n```text\nt\n```" in text and "[safety: restricted_sensitivity]" in text
    none = packages.rendered(rows.where("false").withColumn("ord", F.lit(1)), "P", "now", 0).first()[0]
    assert none.count("- None") == 3 and "1. No questions." in none and "No AI-ready sources were included." in none


def test_unknown_reference_fails(spark):
    bad = lambda c: every(c).withColumn("chunkId", F.lit("nope"))
    with pytest.raises(Exception, match="unknown chunk reference"):
        packages.purpose_query(inventory(spark), chunks(spark), bad, limit=2).collect()


def test_append_replace_import(spark):
    new = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "a"), ("3", "q")], "evalId string, docId string")
    got = {(r["evalId"], r["error"]) for r in compare.insertable(new, spark.createDataFrame([("1",)], "evalId string"), "evalId", inventory(spark)).collect()}
    assert got == {("1", "already exists"), ("2", "repeated in the batch"), ("3", "parent not found")}
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "docId string, id string")
    assert [tuple(r) for r in compare.stale(old, old.where("docId = 'a' AND id = '1'")).collect()] == [("a", "2")]
    assert compare.replaced(old, old.where("docId = 'a' AND id = '1'")).count() == 2
    stored = spark.createDataFrame([("x", "f", "h", "google_workspace", True), ("y", "g", "h", "google_workspace", False), ("a", "f", "h", "upload", True)], "id string, fileId string, contentSha256 string, sourceKind string, rehydratable boolean")
    incoming = spark.createDataFrame([("f", "h"), ("g", "h"), ("n", "h")], "fileId string, contentSha256 string")
    assert {r["fileId"]: r["action"] for r in compare.import_actions(incoming, stored).collect()} == {"f": "skip", "g": "overwrite", "n": "create"}
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    pairs = compare.paired(left, right, "k", ["v"])
    assert pairs.where("v_differs").count() == 3 and "| 2 | b | c |" in compare.comparison_report(pairs, "k", ["v"], "T").first()[0]


def test_plans(spark):
    """A top-k before its filter stays there, and a chunk join with a bounded inventory is broadcast."""
    docs = inventory(spark)
    plan = packages.with_chunks(packages.top_inventory(docs, 2, F.col("status") == "curated"), chunks(spark))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
    with pytest.raises(ValueError, match="limit"):
        packages.top_inventory(docs, 0)


def test_reports(spark):
    drafts = {r["blockId"]: r for r in reports.chunk_drafts(chunking.ir_blocks(layout(spark, PAGES_GIVEN))).collect()}
    assert set(drafts) == {"p1-b1", "p1-t0-r1", "i"} and drafts["p1-b1"]["meta"] == {"headingLevel": "2"} and drafts["p1-t0-r1"]["meta"]["bbox"] == "[0.0,0.5,2.0,3.0]"
    got = layout(spark, PAGES_GIVEN).select(reports.block_counts(F.col("pages")).alias("b"), reports.slide_measures(F.col("pages")).alias("s")).first()
    assert got["b"].asDict() == {"blocks": 4, "tables": 1} and got["s"]["hasTableLocators"] and got["s"]["pageCoverage"] == 0.5 and len(got["s"]["textDensityWarnings"]) == 2
    assert reports.pass_rate(spark.createDataFrame([], "passed boolean")).first()["rate"] == 0.0
    fixtures = spark.createDataFrame([("a", "a")], "documentId string, expectedId string")
    expected = spark.createDataFrame([("a", ["x"]), ("b", [])], "documentId string, expectedFields array<string>")
    assert reports.expectations(fixtures, expected).first()["expectedFields"] == ["x"]
    with pytest.raises(Exception, match="documentId must be"):
        reports.expectations(spark.createDataFrame([("a", "z")], fixtures.schema), expected).collect()
    assert [r["maskedName"] for r in reports.paired_names(spark.createDataFrame([("a",), ("b",)], "fileName string"), {"a": "m"}).collect()] == ["m", None]
    shown = reports.prompt_chunks(packages.with_chunks(inventory(spark), chunks(spark))).where("id = 'a1'").first()["prompt"]
    assert shown.startswith("### chunk\n- fileName: a.txt") and shown.endswith("```text\n t \n```")


def test_flag_choice_and_auth(spark):
    flags = spark.createDataFrame([("pdf-conversion", True, [], None), ("pdf-conversion-subtype-2", False, ["t"], None), ("other", True, [], None)], "flagId string, defaultEnabled boolean, enabledTenants array<string>, expiresAt string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert tuple(policy.flag_choice(flags, F.lit("u"), now).first()) == ("pdf-conversion", None)
    assert tuple(policy.flag_choice(flags, F.lit("t"), now).first()) == (None, "conflicting_flags")
    assert tuple(policy.flag_choice(flags.where("flagId = 'other'"), F.lit("t"), now).first()) == (None, "not_enabled")
    each = flags.withColumn("tenant", F.explode(F.array(F.lit("u"), F.lit("t"))))
    assert sorted(map(tuple, policy.flag_choice(each, F.col("tenant"), now, by=("tenant",)).collect())) == [("t", None, "conflicting_flags"), ("u", "pdf-conversion", None)]
    rows = spark.createDataFrame([("T", "a@b.c", None), ("T", "bad", None), (None, None, "x:a@b.co"), (None, None, None)], "t string, a string, p string")
    got = [r[0] for r in rows.select(policy.auth_context(F.col("t"), F.col("a"), F.col("p"))).collect()]
    assert [g and (g["tenantId"], g["email"]) for g in got] == [("t", "a@b.c"), None, ("b.co", "a@b.co"), None]


def test_purpose_query_without_documents_chunks_or_safe_chunks(spark):
    docs, some = inventory(spark), chunks(spark)
    never = lambda c: pytest.fail("selection was called")
    with pytest.raises(packages.EmptyInventory):
        packages.purpose_query(docs.where("false"), some, never)
    with pytest.raises(packages.NoChunks):
        packages.purpose_query(docs, some.where("false"), never)
    held = packages.purpose_query(docs, some.withColumns({"aiUsePolicy": F.lit("requires_masking"), "maskedText": F.lit(None).cast("string")}), never)
    assert held.count() > 0 and held.where("bucket <> 'humanReview'").count() == 0


def test_layout_lifecycle(spark):
    docs = layout(spark, PAGES_GIVEN).select("docId", F.col("docId").alias("id"), "sourceSubtype", "extractorInput", "pages", F.lit("x@y.com").alias("text"), F.lit("uploaded").alias("status"), F.lit("h").alias("contentSha256"), *(F.lit(None).cast("string").alias(c) for c in ("originalCuratorSensitivity", "sensitivityReason", "aiSafeStoragePath")), F.lit(None).cast("timestamp").alias("updatedAt"))
    curate = lambda d: d.withColumns({"c_sensitivity": F.lit("Confidential"), "c_rationale": F.lit("r")})
    risk = lambda d: d.withColumns({"detected": F.lit(False), "recommendedSensitivity": F.lit("Confidential"), "reasons": F.array(F.lit("fine")), "riskRationale": F.lit("w")})
    done, made, evals = lifecycle.layout_lifecycle(docs, curate, risk, F.lit("2024-01-01 00:00:00").cast("timestamp"), "2024-01-01T00:00:00.000Z")
    assert done.first()["status"] == "ai_safe" and made.count() == 3 and made.where("maskedText IS NULL").count() == 0
    assert lifecycle.conversion_audit(evals, docs).first()["result"] == "success"


def test_validity_report_lists_every_error(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 3, None), ("b", 1, None)], "docId string, ord bigint, bad string")
    broken = F.filter(F.array(F.when(F.col("bad").isNotNull(), F.struct(F.lit("p").alias("path"), F.col("bad").alias("message")))), lambda x: x.isNotNull())
    got = {tuple(r) for r in reports.validity_report(rows, broken).select("docId", "passed", "errors", "firstError", "ord", "message").collect()}
    said = lambda k, m: f"chunk[{k}] invariant failed: {m}"
    assert got == {("a", False, 2, said(1, "y"), None, None), ("b", True, 0, None, None, None), ("a", False, None, None, 1, said(1, "y")), ("a", False, None, None, 2, said(2, "x"))}


def test_reference_violations_grow_in_parts(spark, monkeypatch):
    verdicts = "docId long, chunkId long, verdict string"
    refs = spark.createDataFrame([(1, 1, "included"), (1, 1, "excluded"), (1, 2, "included"), (1, 2, "included"), (2, 1, "included"), (2, 1, "included"), (2, 1, "excluded"), (3, 1, "included"), (None, 1, "included"), (4, 1, None)], verdicts)
    allowed = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (4, 1), (None, 1), (9, 9)], "docId long, chunkId long")
    both, again, unknown = "included and excluded", "repeated reference", "unknown reference"
    want = [(1, 1, both), (1, 2, again), (2, 1, both), (2, 1, again), *[(2, 1, unknown)] * 3, (3, 1, unknown), (None, 1, unknown)]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    monkeypatch.setattr(packages, "AT_ONCE", 2)
    assert order(packages.reference_violations(refs, allowed).collect()) == order(want)
    monkeypatch.setattr(packages, "TASK_ROWS", 1000)
    many = spark.range(0, 30_000).select("id", (F.col("id") % 1000).alias("docId"), (F.col("id") % 29_000).alias("chunkId"), F.lit("included").alias("verdict"))
    got = packages.reference_violations(many, many)  # 60 000 rows
    assert max(got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 1000 and got.rdd.getNumPartitions() == 60
    assert got.count() == 1000 and {r["message"] for r in got.collect()} == {again}
