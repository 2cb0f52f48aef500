import itertools
import re
from collections import Counter

import numpy as np

from paperloom.llm import common, interactions


def brute(rows, labels):
    """The contract, document by document and order by order."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    cases = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        cases.append((source or "", {f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = {}
    shapley = Counter()
    for part in {c[0] for c in cases}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [c for c in cases if c[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [c for c in left if f in c[1]]
                redundant = sum(f in c[1] for c in gone)
                left, gone = [c for c in left if f not in c[1]], gone + removed
                unique = sum(c[0] == part and c[1] == {f} for c in cases)
                out[part, order, step] = (len(left), len(removed), redundant, unique, sum(c[2] for c in removed), sum(c[3] for c in removed))
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def held(got):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()}


def test_first_failures():
    table = interactions.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for mask, (k, order) in itertools.product(range(32), enumerate(interactions.ORDERS)):
        assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in documents.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert held(interactions.audit(documents, labels)) == want


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    want = brute([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    got = interactions.audit(odd, labels)
    assert held(got) == want and got.count() == 600 * len({k[0] for k in want})
    assert interactions.audit(empty, labels).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = ("Ab c# d é 日本 " * 300).encode()
    whole = interactions.failures(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "SLICE", size)
        monkeypatch.setattr(interactions, "SLICE", size)
        assert interactions.failures(text) == whole


def test_many_parts_are_handed_on(spark):
    """More parts in one task than it holds."""
    rows = spark.range(2000).selectExpr("concat('p', id % 600) AS part", "int(id % 32) AS mask", "int(id % 4) AS label").coalesce(1)
    got = interactions.removals(rows)
    assert got.count() == 600 * 720 and got.agg({"n": "sum"}).first()[0] == 2000 * 120
    assert np.array_equal(sorted(r[0] for r in got.select("step").distinct().collect()), range(6))
