import io
import json
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.plans import lifecycle
from paperloom.schemas import AUDIT
from paperloom.sources import files, layouts, stores, workspace
from paperloom.streaming import ingest


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="顧客" sheetId="1" r:id="r1"/><sheet name=" " sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>氏名</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>1.5</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3" t="str"><f>A1</f><v>res</v></c><c r="E3" t="e"><v>#N/A</v></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>a|b</t></is></c><c r="C4"><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="B4:C4"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


FILES = "docId string, fileName string, contentType string, content binary, sensitivity string, aiUsePolicy string"


def given(spark):
    row = lambda k, n, c: (k, n, "", c, "Internal", "direct")
    return spark.createDataFrame([
        row("t", "a.TXT", "﻿ hello ".encode()), row("m", "b.md", b"  "), row("c", "c.csv", '名前,"a|b"\n\nx\n'.encode()), row("q", "q.csv", b'a,"b'),
        row("x", "d.xlsx", workbook()), row("p", "e.pdf", b"%PDF"), row("u", "f.txt", b"\xff\xfe"),
    ], FILES)


def test_upload_guard(spark):
    rows = [("a.txt", "text/plain", b"x"), ("a.exe", "", b"x"), ("a.txt", "image/png", b"x"), ("a.txt", "", b""), ("a.pdf", "", bytes(5 * 1024 * 1024 + 1)), ("b.MD", None, b"x")]
    got = [r["reject_code"] for r in files.upload_guard(spark.createDataFrame(rows, "fileName string, contentType string, content binary")).collect()]
    assert got == [None, "extension_not_allowed", "mime_not_allowed", "empty_file", "too_large", None]


def test_extraction(spark):
    good, bad = files.extracted(given(spark))
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {"t:text:paragraph", "c:csv:Sheet1", "q:csv:Sheet1", "x:xlsx:顧客:B2:E4", "x:xlsx:Sheet2:A1:A1"}
    assert got["t:text:paragraph"]["text"] == "hello"
    assert got["c:csv:Sheet1"]["text"] == "| 名前 | a｜b |\n| --- | --- |\n| x |  |" and got["c:csv:Sheet1"]["locator"]["range"] == "A1:B2"
    assert got["q:csv:Sheet1"]["extractionWarnings"][0].startswith("CSV parse failed") and got["q:csv:Sheet1"]["locator"]["range"] == "A1:A1"
    assert got["x:xlsx:顧客:B2:E4"]["text"] == "## 顧客\n\n| 氏名 | rich |  |  |\n| --- | --- | --- | --- |\n| 1.5 | 2024-01-01 | res | #N/A |\n| a｜b |  |  |  |"
    assert got["x:xlsx:顧客:B2:E4"]["sensitivity"] == "Internal"  # its header has empty cells, its rule none
    assert got["x:xlsx:Sheet2:A1:A1"]["text"] == "## Sheet2"
    assert {r["docId"]: r["error"] for r in bad.collect()} == {"p": "no extractor for this extension", "u": "not UTF-8"}


def test_text_layer(spark):
    rows = [("d", 2, "1. 見出し\n\nbody a\nbody b", [[["h", None], ["", " "], ["v", "w"]]]), ("d", 1, "first", [])]
    got = layouts.text_layer(spark.createDataFrame(rows, "docId string, page int, text string, tables array<array<array<string>>>")).first()
    assert [[b["blockId"] for b in p["blocks"]] for p in got["pages"]] == [["p1-b1"], ["p2-t0-r0", "p2-t0-r2", "p2-b3", "p2-b4"]]
    assert got["pages"][1]["blocks"][0]["metadata"] == {"columnCount": "2", "isHeaderRow": "true"} and got["pages"][1]["blocks"][1]["text"] == "v\tw"
    assert got["pages"][1]["blocks"][2]["kind"] == "heading" and got["textContent"].startswith("first\n1.")


def test_models_are_read_with_care(spark):
    answer = json.dumps({"slides": [{"slideNumber": 3, "title": " T ", "blocks": [{"kind": "paragraph", "text": " "}, {"kind": "table", "text": "x"}]}]})
    docs = spark.createDataFrame([(1, answer), (2, f"Here:\n```json\n{answer}\n```"), (3, f"so {answer} ok"), (4, "no"), (5, None), (6, '{"slides":[]}')], "k int, answer string")
    got = {r["k"]: r for r in layouts.read_slides(docs, lambda d: d).collect()}
    for k in (1, 2, 3):
        assert [b["blockId"] for b in got[k]["pages"][0]["blocks"]] == ["s3-title", "s3-b1"] and got[k]["error"] is None
    assert all(got[k]["error"] == "extraction gave no visible text" for k in (4, 5, 6))
    ocr = json.dumps({"pages": [{"pageNumber": 1, "blocks": [{"kind": "paragraph", "text": "a", "confidence": 0.5, "bbox": [1, 2]}]}]})
    scan = layouts.read_scans(spark.createDataFrame([(ocr,)], "answer string"), lambda d: d).first()["pages"][0]["blocks"][0]
    assert scan["blockId"] == "p1-ocr1" and scan["locator"]["bbox"] == [1.0, 2.0, 0.0, 0.0] and scan["metadata"]["ocrConfidence"] == "0.5"


def test_markdown_pages(spark):
    text = "# Title\n\n| a | b |\n|---|---|\n| 1 | 2 |\nprose one\nprose two\n\f\f## Next"
    pages = layouts.markdown_pages(spark.createDataFrame([(text,), ("",)], "text string")).collect()
    assert [[(b["kind"], b["text"]) for b in p["blocks"]] for p in pages[0]["pages"]] == [[("heading", "Title"), ("table", "a\tb"), ("table", "1\t2"), ("paragraph", "prose one prose two")], [("heading", "Next")]]
    assert [p["pageNumber"] for p in pages[0]["pages"]] == [1, 3] and len(pages[1]["pages"]) == 1


def test_snapshot_and_log(spark, tmp_path):
    table = stores.Snapshot(spark, f"{tmp_path}/chunks", "docId string, id string")
    row = lambda *r: spark.createDataFrame(list(r), "docId string, id string")
    assert table.read().count() == 0
    table.write(row(("a", "1"), ("a", "2"), ("b", "1")))
    table.replace(row(("a", "3")))
    assert sorted(map(tuple, table.read().collect())) == [("a", "3"), ("b", "1")] and table.version() == 2
    broken = F.filter(F.array(F.when(F.col("id") == "bad", F.struct(F.lit("id").alias("path"), F.lit("is bad").alias("message")))), lambda x: x.isNotNull())
    with pytest.raises(ValueError, match="is bad"):
        table.replace(row(("b", "bad")), broken)
    table.clear(row(("b", "")))
    assert [tuple(r) for r in table.read().collect()] == [("a", "3")]
    log = stores.Log(spark, f"{tmp_path}/audit", AUDIT, "eventId")
    event = spark.createDataFrame([("t", "u", "d", "success", {"k": "v"})], "tenantId string, actor string, docId string, result string, details map<string,string>")
    log.append(stores.audit_events(event, "document.view", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("0" * 16)))
    assert log.read().first()["eventId"] == np.base_repr(1_704_067_200_000, 36).lower().rjust(9, "0") + "-" + "0" * 16
    with pytest.raises(ValueError, match="already exists"):
        log.append(log.read())


def test_layout_json(spark):
    schema = "schemaVersion int, source struct<fileName:string>, pages array<struct<pageNumber:int>>"
    raw = spark.createDataFrame([('{"schemaVersion":1,"source":{"fileName":"a"},"pages":[{"pageNumber":1}]}',), (None,)], "json string")
    assert [r["ir"] is None for r in stores.read_ir(raw, schema).collect()] == [False, True]
    with pytest.raises(Exception, match="does not fit"):
        stores.read_ir(spark.createDataFrame([("{}",)], "json string"), schema).collect()


def test_workspace(spark, tmp_path):
    key = "A" * 24
    urls = spark.createDataFrame([(f"https://docs.google.com/spreadsheets/d/{key}/edit#gid=0",), (key,), ("x",)], "url string")
    assert [r[0] for r in urls.select(workspace.file_id(F.col("url"))).collect()] == [key, key, None]
    fetch = lambda d: d.withColumns({"http": F.when(F.col("url") == key, 403).otherwise(200), "name": F.lit("Plan"), "mimeType": F.lit(workspace.SHEETS), "content": F.lit(b"PK").cast("binary"), "modifiedTime": F.lit("t")})
    got = workspace.imported(urls, "sheets", fetch).collect()
    assert [r["error"] for r in got] == [None, "drive_forbidden", "invalid_file_id"] and got[0]["fileName"] == "Plan.xlsx"
    rows = [{"fileName": "a b.txt", "sensitivity": "Confidential", "aiUsePolicy": "requires_masking", "maskerEvaluation": {"residualRisk": {"detected": True, "reasons": ["r"]}, "recommendedSensitivity": "Restricted", "rationale": "why"}}, {"fileName": "c.txt", "aiUsePolicy": "direct", "sensitivity": "Public"}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    first, second = workspace.legacy_inventory(spark, str(tmp_path / "s.json")).orderBy("id").collect()
    assert (first["id"], first["status"], first["sensitivity"], first["sensitivityReason"], first["originalCuratorSensitivity"]) == ("w1-0-a-b-txt", "restricted", "Restricted", "why (r)", "Confidential")
    assert second["status"] == "curated"


def test_lifecycle(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("1", "a.txt", "", b"x", "Public"), ("2", "b.txt", "", b"m@x.com", "Confidential"), ("3", "c.txt", "", b"risky", "Confidential"), ("4", "d.txt", "", b"x", "Restricted"), ("5", "e.txt", "", b"x", "odd")], "id string, fileName string, contentType string, content binary, s string")
    docs = lifecycle.initial(rows, now).withColumn("text", F.col("content").cast("string")).drop("content").join(rows.select("id", "s"), "id")
    curate = lambda d: d.withColumns({"c_sensitivity": F.when(F.col("s") != "odd", F.col("s")), "c_rationale": F.lit("r")})
    hit = F.col("text") == "risky"
    risk = lambda d: d.withColumns({"detected": hit, "recommendedSensitivity": F.when(hit, "Restricted").otherwise("Confidential"), "reasons": F.when(hit, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")), "riskRationale": F.lit("w")})
    got = {r["id"]: r for r in lifecycle.text_lifecycle(docs, curate, risk, now).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"1": "curated", "2": "ai_safe", "3": "restricted", "4": "blocked", "5": "failed"}
    assert got["2"]["aiSafeContent"] == "[REDACTED:EMAIL]" and got["3"]["sensitivityReason"] == "w (n)" and got["5"]["curatorError"]["message"]


def test_lifecycle_runs_a_classifier_once(spark):
    """A classifier that gives each run other labels still places every document in exactly one branch."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.range(200).select(F.col("id").cast("string"), F.lit("a.txt").alias("fileName"), F.lit("").alias("contentType"), F.lit(b"x").alias("content"), F.lit("x").alias("text"))
    docs = lifecycle.initial(rows, now, keep=("text",)).drop("content")
    any_of = F.udf(lambda _: ("Public", "Confidential")[uuid.uuid4().int % 2], "string").asNondeterministic()
    curate = lambda d: d.withColumns({"c_sensitivity": any_of("id"), "c_rationale": F.lit("r")})
    risk = lambda d: d.withColumns({"detected": F.lit(False), "recommendedSensitivity": F.lit("Confidential"), "reasons": F.array(F.lit("n")), "riskRationale": F.lit("w")})
    got = lifecycle.text_lifecycle(docs, curate, risk, now)
    assert sorted(int(r["id"]) for r in got.select("id").collect()) == list(range(200))
    assert {r[0]: r[1] for r in got.groupBy("status").count().collect()} == {r[0]: r[1] for r in got.groupBy("status").count().collect()}


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", "x"), ("b.txt", "x"), ("c.exe", "x"), ("d.txt", "y")):
        (tmp_path / "in" / name).write_text(body)
    out = f"{tmp_path}/out"
    stream = ingest.once(ingest.landing(spark, f"{tmp_path}/in"))
    q = ingest.ingest(stream, lambda df, k: df.select("contentSha256").write.mode("append").parquet(out), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_csv_cells_of_any_length_and_misplaced_quotes():
    long = "x" * 140_000
    assert files.csv_rows(f"a,{long}\n1,2") == ([["a", long], ["1", "2"]], None)
    assert files.csv_rows('a,"b ""c"", d\n"\r\n\n1,2') == ([["a", 'b "c", d\n'], ["1", "2"]], None)
    for wrong in ('a"b"c,d', '"a"b,c', '"a', 'a,b"'):
        rows, error = files.csv_rows(wrong)
        assert rows == [] and error.startswith("CSV parse failed")
