import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from paperloom.llm import blocks
from paperloom.llm import simhash as s
from paperloom.llm.components import components


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, distance=4):
    """The least member of each one's component."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def near(n, seed, flips=6):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(5):
            x = base
            for _ in range(rng.randrange(flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 300, 70_000 // 50):
        text = " ".join(rng.choice(["A", "bé", "cc", "Ü"]) for _ in range(n))
        assert s.majority(s.shingle_hashes(text.encode(), 4)) == brute_fingerprint(text)
    h = np.frombuffer(rng.randbytes(8 * 140_000), np.uint64)
    assert s.majority(h) == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_gray_rank_is_the_place_in_gray_order():
    assert [int(s.gray_rank(np.array([k ^ k >> 1], np.uint64))[0]) for k in range(64)] == list(range(64))


def test_index_finds_every_pair():
    fps = np.unique(np.array(near(200, 2), np.uint64))[:, None]
    want = {(int(a[0]), int(b[0])) for i, a in enumerate(fps) for b in fps[:i] if int(a[0] ^ b[0]).bit_count() <= 4}
    got = set()
    for first, width in s.band_edges(64, 5, None):
        r = s.rotated(fps, first)
        cell = (r >> np.uint64(64 - width)).astype(np.int64)
        o = np.lexsort((s.gray_rank(r), cell))
        words = np.ascontiguousarray(fps[o])
        for a, b, _ in s.GrayIndex(cell[o], words).links(4):
            got |= {tuple(sorted((int(words[x, 0]), int(words[y, 0])), reverse=True)) for x, y in zip(a, b, strict=True)}
    assert got == want


def test_index_cuts_its_frontier(monkeypatch):
    monkeypatch.setattr(s, "FRONTIER", 64)
    fps = np.unique(np.array([k for k in range(300)], np.uint64))[:, None]
    pairs = sum(len(a) for a, *_ in s.GrayIndex(np.zeros(300, np.int64), fps).links(2))
    assert pairs == sum((a ^ b).bit_count() <= 2 for a in range(300) for b in range(a))


@pytest.mark.parametrize("cell_rows", [20_000, 20])
def test_groups(spark, cell_rows):
    """Also when cells are cut into blocks."""
    fps = near(120, 3) + [k for k in range(200)]
    df = spark.createDataFrame([(x.to_bytes(8, "big"),) for x in fps], "fp binary")
    want = brute_groups(fps)
    got = {int.from_bytes(r["fp"], "big"): int.from_bytes(r["root"], "big") for r in s.groups(df, cell_rows=cell_rows).collect()}
    assert got == {f: r for f, r in want.items() if f != r}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200), (200, 201), (None, 3)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {201: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def check(got, docs):
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    root = brute_groups([f for _, f in fps])
    least = defaultdict(list)
    for d, f in fps:
        least[root[f]].append(d)
    want = sorted((d is None, d, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for d, f in fps)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_documents(documents):
    check(s.near_duplicates(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_rows(odd, empty):
    got = s.near_duplicates(odd).collect()
    check([r for r in got if r["doc_id"] is not None], [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    assert s.near_duplicates(empty).count() == 0


def test_deduplication(spark, odd, empty):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        for _ in range(4):
            w[rng.randrange(400)] = "changed"  # of 396 shingles of five words at most 20 change: a similarity of 0.9
        rows += [(100 + k, " ".join(w)), (200 + k, t), (200 + k, t)]
    got = s.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(30))
    kept = s.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("fp <> 'old' OR _row <> 'old'").count() == 0 and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 4]
    assert s.deduplicated(empty).count() == 0


@pytest.mark.parametrize("cell_rows, texts_a_block", [(20_000, 512), (20, 2)])
def test_only_similar_texts_are_duplicates(spark, monkeypatch, cell_rows, texts_a_block):
    """The rows that stay are those of components of exact similarity, on pairs and stars of all similarities around 0.8."""
    monkeypatch.setattr(s.linked, "__defaults__", (*s.linked.__defaults__[:-1], cell_rows))
    monkeypatch.setattr(blocks, "BLOCK_MEMBERS", texts_a_block)
    rng = random.Random(11)
    words, texts = [f"word{k}" for k in range(3000)], []
    for k in range(60):
        base = [rng.choice(words) for _ in range(300)]
        texts.append(base)
        for j in range(4):  # a changed word changes five of 296 shingles
            w = list(base)
            for at in rng.sample(range(0, 300, 5), 3 + (k + 3 * j) % 14):
                w[at] = f"new{rng.random()}"
            texts.append(w)
    texts = [" ".join(w) for w in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = s.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))
    assert 60 < len(set(root)) < 300


def test_a_large_group_of_near_copies_that_mostly_differ(spark, monkeypatch):
    """One group by fingerprints whose members are alike in part only, over many blocks."""
    monkeypatch.setattr(blocks, "BLOCK_MEMBERS", 16)
    rng = random.Random(3)
    base = [f"word{k}" for k in range(300)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.sample(range(0, 300, 5), rng.randrange(3, 12)):
            w[at] = f"new{rng.random()}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = s.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root)) and 10 < len(set(root)) < 140


def test_alike():
    a = set(range(100))
    assert s.alike(a, set(range(80)), 0.8) and not s.alike(a, set(range(79)), 0.8) and s.alike(set(), set(), 0.8) and not s.alike(a, set(), 0.8)


def test_rows_of_a_hot_group_grow_with_its_members(spark, monkeypatch):
    """Members of one group that mostly differ, at three sizes: what is written for their comparison grows with them, and only numbers of blocks are paired."""
    monkeypatch.setattr(blocks, "BLOCK_MEMBERS", 64)
    made, packed = [], blocks.packed

    def counting(members):
        held, counts = packed(members)
        n = held.selectExpr("size(held) AS n").agg({"n": "sum"}).first()[0]
        made.append((n, held.count(), blocks.cells(counts).count()))
        return held, counts

    monkeypatch.setattr(blocks, "packed", counting)
    base = [f"word{k}" for k in range(200)]
    for size in (100, 200, 400):
        rng, texts = random.Random(size), []
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(0, 200, 5), 6):
                w[at] = f"new{rng.random()}"
            texts.append(" ".join(w))
        s.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).count()
    assert all(n <= size for (n, _, _), size in zip(made, (100, 200, 400), strict=True)) and made[2][0] > 200
    assert all(held <= n // 32 + 2 and cells <= held * held for n, held, cells in made)


def test_sorted_sets_are_compared_as_sets():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ({rng.randrange(60) for _ in range(rng.randrange(40))} for _ in range(2))
        assert s.similar_sets(*(np.array(sorted(x), np.uint64) for x in (a, b)), 0.5) == s.alike(a, b, 0.5)
