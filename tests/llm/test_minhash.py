import random
import re

import numpy as np
import pytest

from paperloom.llm import blocks, common, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([" ".join(w)] if w else [])


def brute(rows):
    """All pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(up(i), up(j))] = min(up(i), up(j))
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[up(k)] = min(doc, least.get(up(k), doc))
    out = []
    for k, (doc, _) in enumerate(rows):
        c = least.get(up(k)) if sets[k] else doc
        out.append((doc, len(sets[k]), c, doc == c))
    return sorted(out, key=repr)


def held(got):
    return sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_documents(documents):
    assert held(minhash.deduplicated(documents)) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, empty):
    assert held(minhash.deduplicated(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert minhash.deduplicated(empty).count() == 0


def drifting(n, seed, words=60, step=2):
    """Texts of which each differs from the one before in a few words, so near ones are alike and far ones are not."""
    rng = random.Random(seed)
    text = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        at = rng.randrange(words - step)
        text = text[:at] + [f"v{rng.randrange(10**6)}" for _ in range(step)] + text[at + step :]
    return out


def test_chains_of_near_copies(spark, monkeypatch):
    """Members that are not alike with their bucket's head are compared with each other; blocks of three members."""
    monkeypatch.setattr(blocks, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(minhash, "STAR", 4)
    rows = [(k, t) for k, t in enumerate(drifting(40, 1) + drifting(40, 2) + drifting(60, 3, 30, 1))]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = held(minhash.deduplicated(docs))
    assert got == brute(rows) and 3 < len({r[2] for r in got}) < 120


def test_min_max_estimates_are_unbiased_with_less_variance():
    """Over many pairs of similarity 1/3 to 0.8, agreeing entries of minima and maxima estimate it better than minima alone."""
    rng = np.random.Generator(np.random.Philox(3))
    errors, minima = [], []
    for n in (1000, 2000, 4000):
        for _ in range(60):
            every = rng.integers(0, 1 << 64, 3000 + n, np.uint64)
            a, b = (minhash.signature(np.unique(x)) for x in (every[: 1500 + n], every[1500:]))
            true = n / (3000 + n)
            errors.append((a == b).mean() - true)
            minima.append((a[::2] == b[::2]).mean() - true)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.85 * np.std(minima)


def test_a_pair_at_the_limit_meets():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-6
    rng = np.random.Generator(np.random.Philox(4))
    for _ in range(300):
        every = rng.integers(0, 1 << 64, 500, np.uint64)
        a, b = np.unique(every[:450]), np.unique(every[50:])
        assert minhash.like(a, b) and (minhash.bands(a) == minhash.bands(b)).any()


@pytest.mark.parametrize("size", [1, 5, 64])
def test_slices_give_the_same_set(monkeypatch, size):
    text = " ".join(f"w{k % 37}X{k % 11}" for k in range(500)).encode()
    whole = minhash.Hashes().shingles(text)
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr(common, "SLICE", size)
    assert np.array_equal(minhash.Hashes().shingles(text), whole)
    for few in (b"a", b"a b", b"a b c", b"", b" \n "):
        assert len(minhash.Hashes().shingles(few)) == bool(few.split())


def test_rows_written_grow_with_the_members(spark, monkeypatch):
    """Blocks and cells of one group whose members mostly differ."""
    counts = []
    for n in (400, 800, 1600):
        members = spark.range(n).selectExpr("1L AS grp", "binary(string(id)) AS u", "binary(string(id)) AS label", "true AS rest", "binary(repeat('x y ', 2000)) AS payload")
        held_in, per = blocks.packed(members)
        counts.append((held_in.count(), blocks.cells(per).count()))
    assert all(b <= n // 100 and c <= b * b for n, (b, c) in zip((400, 800, 1600), counts, strict=True)) and counts[2][0] <= 4 * counts[0][0] + 4
