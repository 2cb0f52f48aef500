import zlib

import pytest

import corpus_pipeline
from paperloom.llm import pseudonyms, quality
from paperloom.llm.common import table, written

from .conftest import DATA
from .test_decontaminate import brute
from .test_packing import held


def test_stages_in_order(spark):
    docs = table(spark, DATA, "documents")
    bench = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, DATA))
        after = {r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS) and set(after) <= set(before)
        if k == 0:
            assert set(after) == {r["doc_id"] for r in quality.apply(table(spark, DATA, "documents")).where("kept").collect()}
        if k == 1:
            texts = [r["text"] for r in after.values()]
            assert len(set(texts)) == len(texts) < len(before)
        if k == 2:
            assert set(after) == {d for d, r in before.items() if not brute(r["text"], bench)[1]} < set(before)
        if k == 3:
            change = pseudonyms.Pseudonymizer(pseudonyms.session_key(spark))
            assert set(after) == set(before) and all(after[d]["text"] == change(before[d]["text"])[0] and len(after[d]["text"]) == len(before[d]["text"]) for d in before)
        if k == 4:
            held(after, {d: r["text"] for d, r in before.items()})


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    rows = got.collect()
    assert rows and len({r["sequence_id"] for r in rows}) == len(rows) and all(zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd, empty, k):
    shape = lambda d: d.withColumn("n_chars", d["kept"].cast("bigint"))
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, shape(odd), DATA).count() >= 0 and stage(spark, shape(empty), DATA).count() == 0

