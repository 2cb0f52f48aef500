import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import common, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, longest=5, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    inside = {}
    frequent = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in frequent.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, *w[i:j]] = max(inside.get((lang, *w[i:j]), 0), a)
    out = []
    for (lang, *w), a in frequent.items():
        if 100 * inside.get((lang, *w), 0) < 100 * a:
            score, _, left, right = min((1000 * a * total[lang] // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    ranked = []
    for lang in total:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(ranked)


def held(got):
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"bucket_bits": 6, "frequent_bits": 8}])
def test_documents(spark, documents, sizes):
    """Tiny bitmaps let nearly everything through, and the result stays."""
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    assert held(phrases.collocations(documents, least=8, top=50, **sizes)) == brute(rows, 8, top=50)


def test_odd_rows(spark, odd, empty):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    got = held(phrases.collocations(odd, least=2))
    assert got == brute(rows, 2) and {r[0] for r in got} >= {"en", "und"}
    assert phrases.collocations(empty).count() == 0 and phrases.collocations(odd, least=10**9).count() == 0


def test_more_than_64_bits():
    assert 1000 * 10**13 * 10**14 < 10**38  # a trillion documents of a hundred words


def test_a_longer_phrase_of_equal_count_hides_its_parts(spark):
    docs = spark.createDataFrame([("a b c d. x a b", "en")] * 4 + [("b c", None)] * 4 + [("É! é A\tb", "en")], "text string, lang string")
    got = held(phrases.collocations(docs, least=4))
    assert got == brute([(r["text"], r["lang"]) for r in docs.collect()], 4) and {r[2] for r in got} == {"a b c d", "a b", "x a b", "b c"}


@pytest.mark.parametrize(("k", "size"), [(k, s) for k in (1, 2, 3) for s in (1, 9, 40)])
def test_slices_lose_no_window(monkeypatch, k, size):
    """Counts and buckets of a text cut anywhere are those of the whole."""
    rng = random.Random(size)
    text = "".join(rng.choice(["ab", "c", "dd", " ", "  ", ". ", "\n", " e "]) for _ in range(400))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text, text[::-1]]})
    every = SimpleNamespace(value=np.full(1 << 20, ~np.uint64(0)))

    def run():
        counts, buckets = Counter(), Counter()
        for out in phrases.Pass(k, 5, (8, 26), every, every)(iter([batch])):
            for r in out.to_pylist():
                if r["chunk"] is None:
                    counts[r["lang"], r["phrase"]] += r["n"]
                else:
                    buckets.update(dict(enumerate(pa.decompress(r["counters"], 256, phrases.CODEC, asbytes=True))))
        return counts, buckets

    whole = run()
    want = Counter((lang, " ".join(w[i : i + k])) for lang, t in (("en", text), ("de", text[::-1])) for w in pieces(t) for i in range(len(w) - k + 1))
    assert whole[0] == want and sum(whole[1].values()) == sum(max(0, len(w) - k) for t in (text, text[::-1]) for w in pieces(t))
    monkeypatch.setattr(common, "SLICE", size)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert run() == whole
