import random
import re

from paperloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    w = words(text)
    inside, found = set(), set()
    for item, t in items:
        p = words(t)
        m = min(size, len(p))
        for k in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[k : k + m]:
                    inside |= set(range(j, j + m))
                    found |= set() if item is None else {str(item)}
    return len(w), len(inside), sorted(found)


def cases():
    rng = random.Random(3)
    vocab = ["A", "b", "Öl", "x1", "日本", "é"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 16)))) for k in range(40)] + [(None, "null id words"), (7, "Second text of seven"), (99, None), (98, "!!! ..."), (2, "only"), (10, "one. two")]
    docs = []
    for k in range(80):
        parts = [" ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randrange(0, 30)))]
        parts += [t or "" for _, t in rng.sample(items, 2)]
        rng.shuffle(parts)
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(100, None), (100, ""), (None, "NULL id, words"), (101, "only only")], items


def test_against_brute_force(spark):
    docs, items = cases()
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted((k is None, k, t or "", *map(str, brute(t, items))) for k, t in docs)
    for chars in (d.BLOCK_CHARS, 200):  # one block, and many that add up
        got = d.decontaminate(table, bench, block_chars=chars).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "", str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == want
        assert all(r["contaminated"] == (r["n_hit"] > 0) and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, " ".join(f"w{k}" for k in range(5, 30)))], "item_id bigint, text string")
    got = d.decontaminate(odd, bench)
    assert got.columns == [*(c for c in odd.columns if c not in ("N_Words", "items")), "n_words", "n_hit", "items", "spans", "contaminated"]
    rows = got.collect()
    assert sorted(r["n_hit"] for r in rows if r["doc_id"] == 1) == [0, 5, 5] and {r["n_hit"] for r in rows if r["doc_id"] in (4, 5)} == {25 * 62}
    assert d.decontaminate(empty, bench).count() == 0
    none = d.decontaminate(odd, bench.where("false"))
    assert none.count() == 10 and none.where("contaminated").count() == 0


def test_blocks_in_one_pass(spark):
    """Many blocks of the benchmark are one step over the documents, and no table is written between them."""
    docs, items = cases()
    got = d.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=200)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_slices(monkeypatch):
    """Occurrences that go over the ends of slices, at every slice length."""
    docs, items = cases()
    tables = d.indexes(items)
    for size in (1, 3, 10, 40):
        monkeypatch.setattr("paperloom.llm.common.SLICE", size)
        for _, text in docs:
            found = set()
            inside = d.searched((text or "").encode(), tables, found)
            assert (len(inside), int(inside.sum()), sorted(found)) == brute(text, items)


def test_shared_slots_and_memory():
    """A shift table of few slots finds the same, and tables take a bounded number of bytes a character."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(3_000)] + [(k, "one hot window of ten words that many items hold") for k in range(3_000, 6_000)]
    tables = d.indexes(items)
    assert sum(t.nbytes() for t in tables) < 12 * sum(len(t) for _, t in items)
    found = set()
    inside = d.searched(f"x {items[7][1]} y {items[-1][1]} {items[-1][1]}".encode(), tables, found)
    assert int(inside.sum()) == 40 + 2 * 10 and found == {"7", *map(str, range(3_000, 6_000))}
