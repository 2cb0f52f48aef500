import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperloom.llm import packing


def reference():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def held(rows, texts):
    """Pieces of each text, in order, are its ids with the end id; each sequence is one whole piece."""
    token = reference()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*token.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by.pop(doc), key=lambda r: r["start"])
        assert np.array_equal(np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]), ids)
        at = 0
        for r in got:
            assert (r["start"], r["offset"], r["doc_tokens"]) == (at, 0, len(ids))
            assert r["length"] == 1 << r["bucket"] == len(r["ids"]) // 4 <= 1024 and zlib.crc32(r["ids"]) == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    assert not by


def test_pieces():
    for n in (1, 2, 1023, 1024, 1025, 5000):
        got = packing.pieces(n)
        assert [a for a, _ in got] == [sum(1 << e for _, e in got[:k]) for k in range(len(got))] and sum(1 << e for _, e in got) == n
        assert [e for _, e in got] == sorted((e for _, e in got), reverse=True)


def test_documents(spark, documents):
    rows = packing.pack(documents).collect()
    held(rows, {r["doc_id"]: r["text"] for r in documents.collect()})
    ids = [r["sequence_id"] for r in rows]
    assert len(set(ids)) == len(ids)
    by_id = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["bucket"] for r in by_id] == sorted(r["bucket"] for r in rows)  # buckets are ranges of ids


def test_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1] and sum(r["length"] for r in rows if r["doc_id"] == 4) == sum(r["length"] for r in rows if r["doc_id"] == 5) > 60_000
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a  b\n\n c\t", "naïve café — “x”", "日本語 のテスト ①²", "😀👩‍👩‍👧 ‍ x", "1234567 3.14 it's we'll I'M", "<|endoftext|> x", "a<|endoftext|>b <|endoftext|><|endoftext|", "a" * 500, "  　 x y"])
def test_same_ids_as_the_json_vocabulary(text):
    assert packing.ids_of(packing.vocabulary(), text) == reference().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [a + run + b for run in (" " * 12_000, "\n" * 12_000, " \n\u3000" * 5_000, "\t" * 9_999) for a, b in (("a", "b"), ("", ""), ("x ", " <|endoftext|>"), ("'s", "\x1cz"))])
def test_long_white_space_has_the_same_ids(text):
    assert packing.ids_of(packing.vocabulary(), text) == reference().encode(text, add_special_tokens=False).ids


def test_runs_of_ten_megabytes(spark):
    n = 10_000_000
    kinds = [" ", "\n", "\u3000", "a", "7", "!", "\u00e9"]
    docs = spark.createDataFrame([(k,) for k in range(len(kinds))], "doc_id bigint").selectExpr("doc_id", f"concat('a', repeat(array({', '.join(repr(c) for c in kinds)})[int(doc_id)], {n}), 'b') AS text")
    got = {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert len(got) == len(kinds) and got[0] == n + 2  # the ids of 'a', of blanks but one, of ' b', and the end
