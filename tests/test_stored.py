import json
import os
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import packages
from paperloom.plans import lifecycle
from paperloom.sources import calls, drive, exports, layouts, objects, scans, tables
from tests import stub_client


# objects


def test_objects_are_written_once_and_whole(spark, tmp_path):
    files = spark.createDataFrame([(str(k), f"f{k}.bin", bytes([k]) * (1000 * k)) for k in range(40)], "id string, fileName string, content binary").repartition(5)
    root = f"{tmp_path}/store"
    got = {r["path"]: r for r in objects.written_objects(objects.raw_objects(files), root).collect()}
    assert len(got) == 40 and got["raw/7/f7.bin"]["bytes"] == 7000
    assert all(open(f"{root}/{p}", "rb").read() == bytes([int(p.split("/")[1])]) * r["bytes"] for p, r in got.items())
    again = objects.written_objects(objects.raw_objects(files.where("id = '7'").withColumn("content", F.lit(b"new"))), root)
    assert again.first()["bytes"] == 3 and open(f"{root}/raw/7/f7.bin", "rb").read() == b"new"
    assert sum(len(f) for _, _, f in os.walk(root)) == 40  # no temporary ones are left
    uri = objects.written_objects(objects.raw_objects(files.limit(1)), f"file://{tmp_path}/by-uri")
    assert uri.count() == 1 and os.listdir(f"{tmp_path}/by-uri/raw")


def test_a_repeated_task_leaves_no_second_copy(tmp_path):
    """Renaming twice is renaming once, and an attempt's temporary objects are its own."""
    import pyarrow as pa

    (tmp_path / "_temporary/j/1").mkdir(parents=True)
    (tmp_path / "_temporary/j/1/0").write_bytes(b"abc")
    batch = pa.RecordBatch.from_pydict({"path": ["a/b"], "temporary": ["_temporary/j/1/0"], "bytes": [3]})
    for _ in range(2):
        assert [b.to_pydict() for b in objects._Renaming(objects.opener(str(tmp_path)))(iter([batch]))] == [{"path": ["a/b"]}]
    assert (tmp_path / "a/b").read_bytes() == b"abc"
    (tmp_path / "a/b").write_bytes(b"ab")
    with pytest.raises(OSError, match="neither"):
        list(objects._Renaming(objects.opener(str(tmp_path)))(iter([batch])))


@pytest.mark.parametrize("path", ["../out", "/abs", "", "a//b", "_temporary/x", "a/./b"])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(ValueError, match="not below"):
        objects.written_objects(spark.createDataFrame([(path, b"x")], "path string, content binary"), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_failing_task_leaves_no_object(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"x"), ("a", b"y")], "path string, content binary")
    with pytest.raises(ValueError, match="twice"):
        objects.written_objects(rows, str(tmp_path))
    bad = spark.range(4).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 3, F.lit(b"x")).otherwise(F.raise_error(F.lit("on purpose")).cast("binary")).alias("content"))
    with pytest.raises(Exception, match="on purpose"):
        objects.written_objects(bad, str(tmp_path))
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if not f.endswith(".crc") and f.startswith("o")]


def test_masked_and_layout_objects(spark, tmp_path):
    docs = spark.createDataFrame([("1", "ai_safe_ready", "body", "p"), ("2", "restricted_promoted", "secret", "p")], "id string, decision string, maskedContent string, provider string")
    got = objects.written_objects(objects.masked_bodies(docs), str(tmp_path)).collect()
    assert [(r["path"], r["bytes"]) for r in got] == [("masked/1", 4)]
    layout = spark.createDataFrame([("d", "a.pdf", 1, ("a.pdf",), [(1,)])], "docId string, fileName string, schemaVersion int, source struct<fileName:string>, pages array<struct<pageNumber:int>>")
    objects.written_objects(objects.layout_objects(layout), str(tmp_path)).collect()
    assert json.load(open(f"{tmp_path}/raw/d/a.pdf/document-ir/v1.json"))["pages"] == [{"pageNumber": 1}]


# exports


def test_shards_in_order_are_the_rows_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("evalId"), F.when(F.col("id") % 7 > 0, F.date_format(F.timestamp_seconds((F.col("id") * 7919 % 400) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("createdAt")).repartition(7)
    assert exports.jsonl(rows, f"{tmp_path}/out", *exports.sample_order(), shard_rows=600, file_rows=300) == 5000
    files = [f"out/{f}" for f in exports.shards(spark, f"{tmp_path}/out")]
    lines = [json.loads(x) for f in files for x in open(f"{tmp_path}/{f}")]
    want = sorted(map(tuple, rows.collect()), key=lambda r: (r[1] or "1970-01-01T00:00:00Z", r[0]))
    assert [(r["evalId"], r["createdAt"]) for r in lines] == want and len(files) > 10
    assert max(sum(1 for _ in open(f"{tmp_path}/{f}")) for f in files) <= 300


def test_samples_are_limited_before_they_are_sorted(spark):
    result = json.dumps({"coverage": {"pageCoverage": 0.5, "textDensityWarnings": ["w"], "tableCandidates": 1}, "locatorQuality": {"hasPageLocators": True}, "contextPackageReadiness": {"oversizedChunks": 0}, "safetyReadiness": {"unmaskablePiiFindings": 0, "maskableChunkRate": 1}})
    given = [("a", "d1", "health", "2024-03-01T00:00:00Z", result, None), ("b", "d2", "health", None, result, None), ("c", "d1", "odd", None, result, None), ("d", "d1", "golden", "2024-01-01T00:00:00Z", "{}", None), ("e", "d3", "golden", "2024-01-01T00:00:00Z", result, "official-doc-pdf"), ("f", "d1", "health", "2020-01-01T00:00:00Z", result, None)]
    evals = spark.createDataFrame([(i, d, "r", s, c, r, k) for i, d, s, c, r, k in given], "evalId string, docId string, revisionId string, stage string, createdAt string, result string, sourceSubtype string")
    docs = spark.createDataFrame([("d1", "official-doc-pdf"), ("d2", "slide-pdf")], "id string, sourceSubtype string")
    for limit, ids, skipped in ((None, "fea", (1, 2)), (2, "ea", (1, 2)), (1, "a", (0, 0)), (9, "fea", (1, 2)), (0, "", (0, 0))):
        rows, counts = exports.evaluation_samples(evals, docs, limit=limit)
        assert "".join(r["evalId"] for r in rows.orderBy(*exports.sample_order()).collect()) == ids and tuple(counts.first()) == skipped
    assert rows.schema.simpleString() == spark.createDataFrame([], exports.SAMPLES).schema.simpleString()


# tolerant scans and attempts


def test_stored_chunks(spark):
    good = {"docId": "d", "sourceType": "s", "structureType": "p", "text": "t", "sensitivity": "Public", "aiUsePolicy": "direct", "sourceHash": "h"}
    cases = [
        ("own", json.dumps(good), None), ("x", json.dumps(good | {"id": "y", "createdAt": "2024-01-01T00:00:00.000Z"}), None), ("n", None, "not a JSON object"), ("l", "[1]", "not a JSON object"), ("g", json.dumps(good) + "]", "not a JSON object"), ("e", "", "not a JSON object"),
        ("t", json.dumps(good | {"maskedSpansCount": "many"}), "a field has another type"), ("r", json.dumps(good | {"text": None, "docId": None}), "required: docId, text"), ("s", json.dumps(good | {"sensitivity": "odd"}), "unknown sensitivity odd"), ("p", json.dumps(good | {"aiUsePolicy": "odd"}), "unknown aiUsePolicy odd"),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "id string, data string")
    assert {r["id"]: r["problem"] for r in scans.stored_chunks(rows).collect()} == {i: p for i, _, p in cases}
    chunks, skipped = scans.listed(rows)
    got = {r["id"]: r for r in chunks.collect()}
    assert set(got) == {"own", "y"} and got["own"]["createdAt"] == got["y"]["updatedAt"] == scans.EPOCH and got["y"]["createdAt"].startswith("2024")
    assert sum(r["skipped"] for r in skipped.collect()) == 8


def test_attempts_are_kept_in_order(spark):
    rows = spark.createDataFrame([
        (1, '{"label":"a"}', "unused", None, None), (2, None, '```json\n{"label":"a"}\n```', None, None), (3, '{"label":"z"}', "prose", '{"label":"q"}', '{"label":"a"} and more'), (4, "{", None, None, " "),
    ], "k int, one string, text1 string, two string, text2 string")
    invalid = lambda v: F.when(~F.coalesce(v["label"].isin("a", "b"), F.lit(False)), F.concat(F.lit("no label "), v["label"]))
    tried = scans.attempts([("structured(output)", F.col("one"), False), ("structured(text)", F.col("text1"), True), ("json+schema(output)", F.col("two"), False), ("json+schema(text)", F.col("text2"), True)], "label string", invalid)
    got = {r["k"]: (r["t"]["value"], [tuple(a) for a in r["t"]["attempts"]], r["m"]) for r in rows.select("k", tried.alias("t")).withColumn("m", scans.attempt_message("Curator", F.col("t"))).collect()}
    assert got[1][0]["label"] == "a" and got[1][1:] == ([], None)
    assert got[2][0]["label"] == "a" and got[2][1] == [("structured(output)", "no output")]
    assert got[3][0] is None and got[3][1] == [("structured(output)", "no label z"), ("structured(text) (JSON.parse)", "not JSON"), ("json+schema(output)", "no label q"), ("json+schema(text) (JSON.parse)", "not JSON")]
    assert got[4][1] == [("structured(output)", "no output"), ("json+schema(output)", "no output")] and got[4][2] == "Curator: no valid answer\nstructured(output): no output\njson+schema(output): no output"


def test_issues_in_the_order_of_a_reader(spark):
    rows = [("s", side, i, d, c, r) for side, refs in (("included", [("d", "1", None), ("d", "2", None), ("d", "1", None), ("d", "1", None)]), ("excluded", [("d", "3", "purpose_mismatch"), ("d", "2", "restricted_sensitivity"), ("d", "2", "purpose_mismatch")])) for i, (d, c, r) in enumerate(refs)]
    rows += [("t", "included", 0, "d", "1", None), ("t", "excluded", 0, "e", "1", "cross_customer_confidentiality")]
    parents = spark.createDataFrame([("d", "1", "x"), ("d", "2", "d")], "docId string, chunkId string, parentDocId string")
    issues = packages.selection_issues(spark.createDataFrame(rows, "selection string, side string, index int, docId string, chunkId string, reason string"), parents)
    got = [(r["selection"], r["ordinal"], r["path"], r["message"]) for r in issues.orderBy("selection", "ordinal").collect()]
    dup, both, gate, parent = "duplicate chunk ref (docId + chunkId) also at ", "chunk ref must not appear in both included and excluded", "Strategist must not emit safety_gate-origin reason: ", "parent.docId must equal chunk.docId"
    assert got == [
        ("s", 1, "included.2.chunkId", dup + "included[0]"), ("s", 2, "included.3.chunkId", dup + "included[0]"), ("s", 3, "excluded.1.chunkId", both), ("s", 4, "excluded.2.chunkId", dup + "excluded[1]"), ("s", 5, "excluded.2.chunkId", both),
        ("s", 6, "excluded.1.reason", gate + "restricted_sensitivity"), ("s", 7, "parent.docId", parent), ("s", 8, "parent.docId", parent), ("s", 9, "parent.docId", parent), ("t", 1, "excluded.0.reason", gate + "cross_customer_confidentiality"), ("t", 2, "parent.docId", parent),
    ]
    assert {(r["selection"], r["path"]) for r in packages.first_issue(issues).collect()} == {("s", "included.2.chunkId"), ("t", "excluded.0.reason")}


# calls


def test_a_call_that_hangs_or_raises_fails_its_row_only(spark):
    began = time.time()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["plain", "hang", "has mail", "raise", "hang too", "last"])], "k int, text string").coalesce(1)
    got = {r["k"]: r for r in calls.called(docs, stub_client.label, ["text"], "c_sensitivity string, c_rationale string", seconds=1.5, at_once=3).collect()}
    assert time.time() - began < 60 and len(got) == 6
    assert [got[k]["callError"] and got[k]["callError"]["kind"] for k in range(6)] == [None, "call-timeout", None, "call-failed", "call-timeout", None]
    assert got[3]["callError"]["message"] == "ValueError: model is down" and got[2]["c_sensitivity"] == "Confidential" and got[5]["c_rationale"] == "las" and got[1]["c_sensitivity"] is None
    odd = calls.called(docs.where("k = 0"), lambda row: [1], ["text"], "n int").first()
    assert odd["n"] is None and "does not fit" in odd["callError"]["message"]


def test_scans_with_a_deadline(spark):
    docs = spark.createDataFrame([(k,) for k in range(4)], "k int")
    got = {r["k"]: r for r in layouts.read_scans(docs, calls.reader(stub_client.answer, ["k"], seconds=1.0)).collect()}
    assert [got[k]["error"] for k in range(4)] == [None, None, "extraction gave no visible text", None] and got[2]["callError"]["kind"] == calls.TIMEOUT
    assert calls.SECONDS == 60 and got[3]["pages"][0]["blocks"][0]["text"] == "t3"


def test_errors_of_every_phase_stay_with_their_row(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    texts = ["fine", "raise", "mail ok", "mail risk fails"]
    files = spark.createDataFrame([(str(k), f"{k}.txt", "", t.encode(), t) for k, t in enumerate(texts)], "id string, fileName string, contentType string, content binary, text string")
    docs = lifecycle.initial(files, now, keep=("text",)).drop("content")
    got = {r["id"]: r for r in lifecycle.text_lifecycle(docs, calls.classifier(stub_client.label, ["text"], 5), calls.risk_check(stub_client.risk, ["text"], 5), now).collect()}
    assert [got[str(k)]["status"] for k in range(4)] == ["curated", "failed", "ai_safe", "failed"]
    assert got["1"]["curatorError"]["message"] == "ValueError: model is down" and got["3"]["maskerError"]["message"] == "RuntimeError: no answer"
    assert got["3"]["sensitivity"] == "Confidential" and got["3"]["aiSafeContent"] is None and got["3"]["masker"] is None and got["2"]["masker"]["decision"] == "ai_safe_ready"
    layouts_ = spark.createDataFrame([("1", "uploaded", None), ("2", "uploaded", "no pages")], "id string, status string, error string")
    assert [(r["status"], r["conversionError"] and r["conversionError"]["message"]) for r in lifecycle.converted(layouts_, now=now).orderBy("id").collect()] == [("uploaded", None), ("failed", "no pages")]


# a data source, migrations


def test_exports_as_a_data_source(spark):
    ids = ["200-a", "403-b", "404-c", "later-d", "busy-e", "dead-f", "200-a"]
    got = drive.exports(spark, ids, "tests.stub_client:export", partition=2, retries=2, wait=0.01)
    assert got.rdd.getNumPartitions() == 3
    rows = {r["fileId"]: r for r in got.collect()}
    assert {k: (r["http"], r["tries"], r["content"] is not None) for k, r in rows.items()} == {
        "200-a": (200, 1, True), "403-b": (403, 1, False), "404-c": (404, 1, False), "later-d": (200, 3, True), "busy-e": (429, 3, False), "dead-f": (0, 3, False),
    }
    assert rows["dead-f"]["error"] == "OSError: no network" and drive.exports(spark, [], "tests.stub_client:export").count() == 0


def test_a_migration_goes_on_where_it_stopped(spark, tmp_path):
    table = tables.BucketedTable(spark, str(tmp_path), "docId string, kind string", buckets=8)
    table.write(spark.range(200).selectExpr("string(id) AS docId", "CAST(NULL AS STRING) AS kind"))
    asked = []

    def change(rows, stop):
        asked.append(1)
        if len(asked) == stop:
            raise KeyboardInterrupt
        return rows.withColumns({"kind": F.lit("upload"), "problem": F.when(F.col("docId") == "7", "locked")})

    with pytest.raises(KeyboardInterrupt):
        table.migrate("kinds", lambda rows: change(rows, 3), at_once=2)
    assert table.manifest()["marks"] == {"kinds": 4} and 0 < table.read().where("kind IS NULL").count() < 200
    table.upsert(spark.createDataFrame([("7", None)], "docId string, kind string"))  # other changes keep the mark
    first = len(asked)
    changed, stayed = table.migrate("kinds", lambda rows: change(rows, 0), at_once=2)
    assert len(asked) - first == 2 and stayed in (0, 1) and table.read().count() == 200
    assert {r["docId"] for r in table.read().where("kind IS NULL").collect()} == {"7"} and table.migrate("kinds", lambda rows: change(rows, 0)) == (0, 0)
    assert 0 < changed < 200


def test_stages_guard_their_input(spark):
    from paperloom.operators import evaluation

    rows = spark.createDataFrame([("a", "scan-pdf", 1.0, True, True, 2, 0, 0, 5), ("b", "slide-pdf", 0.5, True, False, 1, 0, 0, 0)], "docId string, sourceSubtype string, pageCoverage double, hasPageLocators boolean, hasTableLocators boolean, chunkCount int, emptyChunks int, oversizedChunks int, unmaskablePiiFindings int")
    inspect = lambda m: m.withColumns({"unmaskablePiiFindings": F.lit(3), "maskableChunkRate": F.lit(0.5)})
    dry = {r["docId"]: r for r in evaluation.run_stage(rows, "golden").collect()}
    assert [dry[k]["safetyReadiness"] for k in "ab"] == ["pass", "pass"] and dry["a"]["unmaskablePiiFindings"] == 0
    real = {r["docId"]: r for r in evaluation.run_stage(rows, "golden", inspect).collect()}
    assert [real[k]["safetyReadiness"] for k in "ab"] == ["warn", "fail"]
    assert {r["safetyReadiness"] for r in evaluation.run_stage(rows, "health", inspect).collect()} == {"pass"}
    with pytest.raises(Exception, match='health check runner supports subtypes official-doc-pdf, slide-pdf, scan-pdf only: received "csv"'):
        evaluation.run_stage(rows.withColumn("sourceSubtype", F.lit("csv")), "health").collect()
    with pytest.raises(Exception, match="keyFieldRecall is measured at golden only"):
        evaluation.run_stage(rows.withColumn("keyFieldRecall", F.lit(1.0)), "heuristic").collect()
    assert evaluation.run_stage(rows.withColumn("keyFieldRecall", F.lit(1.0)), "golden").count() == 2


def test_directories_in_order(spark, tmp_path):
    from paperloom.sources import files

    for name in ("b+c.txt", "a d.txt", "x.pdf", "sub/e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = [r["fileName"] for r in files.in_order(files.directory(spark, str(tmp_path)), ("txt",)).select("fileName").collect()]
    assert got == ["a d.txt", "b+c.txt", "e.txt"]
