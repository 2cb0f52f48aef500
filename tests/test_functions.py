from pyspark.sql import functions as F

from paperloom.functions import masking, policy, text
from paperloom.functions.invariants import asserted, chunk_violations, document_violations, quarantined, violations
from paperloom.schemas import CHUNK, DOCUMENT


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1)]).select(column.alias("x")).first()["x"]


def test_trim_and_lengths(spark):
    assert one(spark, text.js_trim(F.col("t")), t="　  a b﻿\n") == "a b"
    assert one(spark, text.is_blank(F.col("t")), t=" 　") is True
    assert one(spark, text.utf16_length(F.col("t")), t="a\U0001f600") == 3


def test_names_and_ranges(spark):
    assert one(spark, text.safe_file_name(F.col("t")), t=" a/b\\c ") == "a_b_c"
    assert one(spark, text.safe_file_name(F.col("t")), t="  ") == "file.txt"
    assert one(spark, text.workspace_file_name(F.col("t"), ".xlsx"), t="Plan.XLSX..") == "Plan.XLSX.xlsx"
    assert one(spark, text.a1_range(F.lit(3), F.lit(28))) == "A1:AB3"
    assert one(spark, text.column_number(F.lit("AA"))) == 27
    assert one(spark, text.parsed_range(F.lit("B2:AC10"))).asDict() == {"first_column": 2, "first_row": 2, "last_column": 29, "last_row": 10}
    assert one(spark, text.parsed_range(F.lit("no"))) is None


def test_markdown(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit("c\nd")), F.array(F.lit("1")))
    assert one(spark, text.markdown_table(rows)) == "| a｜b | c d |\n| --- | --- |\n| 1 |  |"


def test_ids_and_bindings(spark):
    assert one(spark, text.eval_id_parts(F.lit("a:b:c"))).asDict() == {"doc_id": "a:b", "revision": "c"}
    assert one(spark, text.eval_id_parts(F.lit("abc"))) is None
    assert one(spark, text.sortable_id(F.lit(1_700_000_000_000), F.lit("0123456789abcdef99"))) == "0loyw3v28-0123456789abcdef"
    import hashlib
    import json

    said = json.dumps({"version": 1, "purpose": "a b", "tenantId": "t", "timestamp": "z"}, separators=(",", ":"))
    assert one(spark, text.purpose_binding(F.lit("  A \n b "), F.lit("t"), F.lit("z"))) == "pb_sha256_" + hashlib.sha256(said.encode()).hexdigest()
    assert one(spark, text.my_number_check_digit(F.lit("12345678901"))) == 8


def test_tenants_and_headers(spark):
    assert one(spark, text.tenant_normalized(F.lit("--Foo Bar!!.com-"))) == "foo-bar-.com"
    assert one(spark, text.proxy_email(F.lit("accounts.google.com: A@B.co"))) == "a@b.co"
    assert one(spark, text.proxy_email(F.lit("nobody"))) is None
    assert one(spark, text.tenant_of_email(F.lit("a@Example.com"))) == "example.com"
    assert one(spark, text.client_address(F.lit(" 1.1.1.1 , 2.2.2.2"), F.lit(None))) == "1.1.1.1"
    assert one(spark, text.client_address(F.lit(None).cast("string"), F.lit(" 3.3.3.3"))) == "3.3.3.3"


def test_unicode_forms(spark):
    df = spark.createDataFrame([("Ａ　Ｂ ｶﾞ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.semantic_key(F.col("t"))).collect()] == ["ABガ", None]
    assert [r[0] for r in spark.createDataFrame([("aé\U0001f600x", 7)], "t string, o bigint").select(text.utf16_index(F.col("t"), F.col("o"))).collect()] == [4]


def test_policies(spark):
    for s, p, status in (("Public", "direct", "curated"), ("Internal", "direct", "curated"), ("Confidential", "requires_masking", "masking"), ("Restricted", "blocked", "blocked"), ("?", None, None)):
        assert one(spark, policy.policy_of(F.lit(s))) == p
        assert one(spark, policy.status_of_policy(policy.policy_of(F.lit(s)))) == status
    assert one(spark, policy.promotion_reason(F.lit("r"), F.array(F.lit("a"), F.lit("b")))) == "r (a; b)"
    gate = lambda s, p, m: one(spark, policy.gate_reason(F.lit(s), F.lit(p), F.lit(m)))
    assert gate("Restricted", "direct", None) == gate("Public", "blocked", "x") == "restricted_sensitivity"
    assert gate("Confidential", "requires_masking", "  ") == "masking_required_unavailable"
    assert gate("Confidential", "requires_masking", "x") is None
    assert one(spark, policy.token_cost(F.lit("gemini-2.5-flash-lite-1"), F.lit(1_000_000), F.lit(1_000_000))) == 0.5
    assert one(spark, policy.newer(F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-01T00:00:00Z"))) is True
    assert one(spark, policy.newer(F.lit("x"), F.lit("y"))) is True


def test_flags(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    on = lambda default, tenants, until: one(spark, policy.flag_enabled(F.lit(default), F.array(*map(F.lit, tenants)).cast("array<string>"), F.lit(until), F.lit("t"), now))
    assert on(None, [], None) is False and on(True, [], None) is True and on(False, ["t"], None) is True
    assert on(True, ["t"], "2024-01-01T00:00:00Z") is False


def test_audit_rules(spark):
    bad = lambda *a: one(spark, policy.inference_violation(*map(F.lit, a)))
    assert bad("slide-pdf", "gemini-vertex", None).startswith("document.convert: inferenceDestination is required")
    assert bad("official-doc-pdf", "pdf-parse", "x").startswith("document.convert: inferenceDestination must not be set")
    assert bad("slide-pdf", "gemini-vertex", "x") is None
    un = lambda *a: one(spark, policy.unmaskable_violation(*map(F.lit, a)))
    assert un("scan-pdf", "gemini-vertex-ocr", "success", None) and not un("scan-pdf", "gemini-vertex-ocr", "error", None) and un("slide-pdf", "x", "success", 1)


MASKED = [
    ("mail caféa@b.com, x", "mail café[REDACTED:EMAIL], x"),
    ("tel 03-1234-5678", "tel [REDACTED:PHONE]"),
    ("〒 123-4567 x", "[REDACTED:POSTAL_CODE] x"),
    ("番号 123456789012 x", "番号 [REDACTED:JP_MYNUMBER] x"),
    ("番号 1234567890123", "番号 1234567890123"),
    ("普通 1234567 ヤマダ", "[REDACTED:BANK_ACCOUNT]"),
    ("金額 1,000円（税込）です", "金額 [REDACTED:AMOUNT_JPY]です"),
    ("甲：会社A\n乙: 会社B", "[REDACTED:COMPANY_NAME_HINT]\n[REDACTED:COMPANY_NAME_HINT]"),
    ("代表取締役 山田", "[REDACTED:PERSON_NAME_HINT]"),
    ("甲側担当: 佐藤\n氏名：鈴木\n会社名: X", "[REDACTED:PERSON_NAME_HINT]\n[REDACTED:PERSON_NAME_HINT]\n[REDACTED:COMPANY_NAME_HINT]"),
    ("", ""),
    (None, None),
]


def test_masking_rules(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(MASKED)], "k int, text string")
    got = {r["k"]: r for r in masking.simple_rule(df).collect()}
    for k, (_, want) in enumerate(MASKED):
        assert got[k]["maskedContent"] == want, MASKED[k]
    assert got[7]["ruleHits"] == {"label_party": 2}


def test_overlaps_go_to_the_first_and_longest(spark):
    span = "array<struct<start:int,end:int,type:string,ruleId:string,rule:int>>"
    df = spark.createDataFrame([([(0, 3, "A", "a", 1), (0, 5, "B", "b", 2), (5, 7, "C", "c", 3), (6, 9, "D", "d", 0)],)], f"s {span}")
    assert [(x["start"], x["end"], x["type"]) for x in df.select(masking.non_overlapping(F.col("s"))).first()[0]] == [(0, 5, "B"), (5, 7, "C")]


def test_chunks_are_masked_only_where_needed(spark):
    df = spark.createDataFrame([("a", "x@y.com", "requires_masking"), ("b", "x@y.com", "direct")], "id string, text string, aiUsePolicy string")
    got = {r["id"]: r for r in masking.mask_chunks(df).collect()}
    assert got["a"]["maskedText"] == "[REDACTED:EMAIL]" and got["a"]["maskedSpansCount"] == 1 and got["b"]["maskedText"] is None


def test_injected_inspection(spark):
    df = spark.createDataFrame([("é a@b.c",)], "text string")
    inspect = lambda d: d.withColumn("findings", F.from_json(F.lit('[{"start":3,"end":8,"infoType":"EMAIL_ADDRESS"},{"start":3,"end":99,"infoType":"X"}]'), "array<struct<start:int,end:int,infoType:string>>"))
    assert masking.inspected(inspect)(df).first()["maskedContent"] == "é [REDACTED:EMAIL]"


def test_document_invariants(spark):
    base = {"id": "d", "status": "curated", "sensitivity": "Public", "aiUsePolicy": "direct", "sensitivitySource": "curator", "contentSha256": "h", "sourceKind": "upload", "curator": {"aiUsePolicy": "direct"}}
    cases = [
        (base, []),
        (base | {"aiSafeStoragePath": "x"}, ["aiSafeStoragePath"]),
        (base | {"sensitivitySource": "masker"}, ["sensitivitySource"]),
        (base | {"originalCuratorSensitivity": "Public"}, ["originalCuratorSensitivity"]),
        (base | {"curator": None}, ["curator", "status"]),
        (base | {"masker": {"decision": "ai_safe_ready", "sourceContentHash": "h"}}, ["masker"]),
        (base | {"curator": {"aiUsePolicy": "requires_masking"}, "maskingPending": True}, []),
        (base | {"sourceKind": "x"}, ["sourceKind"]),
        (base | {"externalSource": {"provider": "google_drive"}}, ["sourceKind"]),
    ]
    import json

    df = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)], "k int, j string").select("k", F.from_json("j", " ".join(DOCUMENT.split())).alias("d")).select("k", "d.*")
    got = {r["k"]: [v["path"] for v in r["v"]] for r in df.select("k", document_violations(df).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    good, bad = quarantined(df, document_violations(df))
    assert good.count() == 2 and bad.count() == 7 and violations(df, "k", document_violations(df)).count() == 8


def test_chunk_invariants(spark):
    import pytest

    chunk = spark.createDataFrame([], " ".join(CHUNK.split()))
    locator = F.struct(F.lit("pdf").alias("kind"), F.lit(None).cast("string").alias("sheetName"), F.lit(None).cast("string").alias("range"), F.lit(1).alias("page"), F.lit("p").alias("paragraphId"), F.lit(None).cast("int").alias("slide"))
    row = spark.range(1).select(
        F.lit("c").alias("id"), F.lit("d").alias("docId"), locator.alias("locator"), F.lit("t").alias("text"), F.lit("").alias("maskedText"), F.lit("Confidential").alias("sensitivity"), F.lit("requires_masking").alias("aiUsePolicy"),
        F.lit("columnRule").alias("sensitivitySource"), F.lit(" ").alias("sensitivityReason"), text.source_hash(F.lit("pdf:1:p"), F.lit("in")).alias("sourceHash"),
    )
    broken = chunk_violations(row, F.lit("e"), F.lit("masking"), F.lit("in"), F.lit(512_001))
    assert [v["path"] for v in row.select(broken).first()[0]] == ["docId", "parentDocument.status", "maskedText", "sensitivityReason", "bytes"]
    assert chunk.count() == 0
    with pytest.raises(Exception, match="parentDocument.id must match"):
        asserted(row, broken, "chunk").collect()


def test_all_amounts_of_a_text_are_masked(spark):
    df = spark.createDataFrame([("月額 1,000円\n金額 2,000円 と 3円",)], "text string")
    row = masking.simple_rule(df).first()
    assert row["maskedContent"] == "月額 [REDACTED:AMOUNT_JPY]\n金額 [REDACTED:AMOUNT_JPY] と [REDACTED:AMOUNT_JPY]"
    assert row["ruleHits"] == {"amount_jpy": 3}


def _rows_at_once(spark, made):
    """Most rows that a worker gets at once when ``made`` has been called, whatever was set before."""
    import pandas as pd

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    made(spark.range(0, 3000, 1, 1).select(F.col("id").alias("docId"), F.concat(F.lit("a@b.com "), F.col("id").cast("string")).alias("text")))
    size = lambda x: pd.Series([len(x)] * len(x))
    return spark.range(0, 3000, 1, 1).select(F.pandas_udf(size, "bigint", F.PandasUDFType.SCALAR)("id").alias("n")).agg(F.max("n")).first()[0]


def test_oversize_blocks_come_in_small_batches(spark):
    from paperloom.operators import chunking
    from paperloom.plans import queries

    assert _rows_at_once(spark, lambda df: chunking.ir_chunks(queries._as_layout(spark, "/root/testdata/sf0.001"))) <= 256


def test_masked_texts_come_in_small_batches(spark):
    assert _rows_at_once(spark, masking.simple_rule) <= 256
    df = spark.createDataFrame([(1, "a@b.com"), (2, None), (3, "")], "id int, text string").withColumn("s", masking.finder()(F.col("text")))
    assert [r["s"] and len(r["s"]) for r in df.orderBy("id").collect()] == [1, None, []]


def test_rule_hits_of_digits_come_in_small_batches(spark):
    from paperloom.plans import queries

    assert _rows_at_once(spark, lambda df: queries.pii_rule_hits_digits(spark, "/root/testdata/sf0.001")) <= 256


def test_emails_are_masked_in_small_batches(spark):
    from paperloom.plans import queries

    assert _rows_at_once(spark, lambda df: queries.masked_text_email(spark, "/root/testdata/sf0.001")) <= 256


def test_digits_of_dense_texts_are_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["090-1234-5678 " * 50_000] * 4)
    tracemalloc.start()
    found = sum(len(x.values) for x in masking.found_spans(iter([texts]), masking.RULES[1:3]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 400_000 and most < 10e6


def test_emails_of_dense_texts_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(masking, "MOST_SPANS", 3)
    texts = [None, "a@b.com " * 5, "", "x", "😀 a@b.com", None, "a@b.com b@c.org"]
    got = list(masking.found_spans(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["c@d.net"])]), masking.RULES[:1]))
    assert [len(x) for x in got] == [2, 5, 1]
    assert [x and [(s["start"], s["end"]) for s in x] for part in got for x in part.to_pylist()] == [None, [(8 * k, 8 * k + 7) for k in range(5)], [], [], [(2, 9)], None, [(0, 7), (8, 15)], [(0, 7)]]


def test_a_text_full_of_addresses_is_masked_in_linear_time(spark, tmp_path):
    import time

    from paperloom.plans import queries

    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("a@b.com "), F.lit(32_000))).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r["doc_id"]: r["masked"] for r in queries.masked_text_email(spark, str(tmp_path)).collect()}
    assert got == {0: "[REDACTED:EMAIL] " * 32_000, 1: None}
    assert time.time() - began < 30


def test_masked_dense_texts_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(masking, "MOST_SPANS", 3)
    texts = [None, "a@b.com " * 5, "", "x\r\n", "😀 a@b.com\r", None, "a@b.com b@c.org"]
    got = list(masking.redacted_texts(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["c@d.net"])]), masking.RULES[:1]))
    assert [len(x) for x in got] == [2, 5, 1]
    rows = [x for part in got for x in part.to_pylist()]
    assert [x["masked"] for x in rows] == [None, "[REDACTED:EMAIL] " * 5, None, None, "😀 [REDACTED:EMAIL]\r", None, "[REDACTED:EMAIL] [REDACTED:EMAIL]", "[REDACTED:EMAIL]"]
    assert [x["spans"] and len(x["spans"]) for x in rows] == [None, 5, [], [], 1, None, 2, 1]


def test_chosen_spans_and_masked_texts_are_those_of_brute_force():
    import random

    import pyarrow as pa

    rnd, names = random.Random(7), ("start", "end", "type", "ruleId", "rule")
    texts = [None, ""] + ["".join(rnd.choice("ab\r\n😀é円") for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    some = lambda t: [(a := rnd.randrange(len(t)), a + rnd.randint(1, 6), rnd.choice("XYZ"), rnd.choice("pq"), rnd.randint(0, 2)) for _ in range(rnd.randint(0, 9))]
    found = [None if t is None else [dict(zip(names, x, strict=True)) for x in (some(t) if t else [])] for t in texts]
    kind = pa.list_(pa.struct([(n, pa.string() if n in ("type", "ruleId") else pa.int32()) for n in names]))
    for text, spans, got in zip(texts, found, masking.settled(pa.array(texts), pa.array(found, kind)).to_pylist(), strict=True):
        kept, want = [], text
        for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"], s["rule"], s["type"], s["ruleId"])):
            if not kept or kept[-1]["end"] <= s["start"]:
                kept.append({n: s[n] for n in names[:4]})
        for s in reversed(kept):
            want = f"{want[: s['start']]}[REDACTED:{s['type']}]{want[s['end'] :]}"
        assert got == {"spans": None if spans is None else kept, "masked": want if kept else None}
