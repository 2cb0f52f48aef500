import math
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import gru, scoring


def test_gradients():
    """Of all parameters, against differences of the loss, with states carried and cleared."""
    n = 70
    cuts = gru.cuts_of(np.arange(n, 0, -1))
    flat = gru.initial(np.arange(n, 0, -1), 30, seed=1)
    rng = np.random.default_rng(0)
    flat = (flat + rng.normal(0, 0.3, len(flat))).astype(np.float64)
    x, y = rng.integers(0, n + 2, (5, 6)), rng.integers(0, n + 1, (5, 6))
    keep = (rng.random((5, 6)) > 0.3).astype(np.float64)
    got = []

    class Probe(gru.Trainer):
        pass

    t = Probe(flat, cuts, rate=0.0)
    t.flat = flat.copy()
    t.p = gru.unpacked(t.flat, cuts)
    t.m, t.v = np.zeros_like(flat), np.zeros_like(flat)
    t._window(x, y, keep, np.zeros((6, gru.HIDDEN)))
    grad = t.m / 0.1

    def loss(f):
        u = Probe(f, cuts, rate=0.0)
        u.flat = f
        u.p = gru.unpacked(f, cuts)
        u.m, u.v = np.zeros_like(f), np.zeros_like(f)
        u._window(x, y, keep, np.zeros((6, gru.HIDDEN)))
        return u.loss

    for k in rng.choice(len(flat), 60, replace=False).tolist() + np.argsort(-np.abs(grad))[:40].tolist():
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        got.append((grad[k], (loss(up) - loss(down)) / 2e-2))
    a, b = np.array(got).T
    assert np.abs(a - b).max() < 2e-4 and np.abs(a).max() > 1e-2


def test_classes():
    counts = np.sort(np.random.default_rng(0).zipf(1.3, 2048))[::-1]
    cuts = gru.cuts_of(counts)
    sizes = np.diff(cuts)
    assert cuts[0] == 0 and cuts[-1] == 2048 and len(sizes) <= gru.CLASSES and (sizes > 0).all() and sizes[0] < sizes[-1]
    assert gru.cuts_of(np.array([5])).tolist() == [0, 1] and gru.cuts_of(np.array([], np.int64)).tolist() == [0]


def test_probabilities_sum_to_one():
    n = 100
    p = gru.unpacked(gru.initial(np.arange(n, 0, -1), 30), gru.cuts_of(np.arange(n, 0, -1)))
    total = 0.0
    for w in range(n + 1):
        total += math.exp(gru._output(p, np.full((1, gru.HIDDEN), 0.3, np.float32), np.array([w]), None)[0][0])
    assert abs(total - 1) < 1e-4


def test_scores_do_not_depend_on_company():
    n = 128
    flat = gru.initial(np.arange(n, 0, -1), 30)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, n + 1, k) for k in (1, 2, 3, 700, 50, 1, 20)]
    cuts = gru.cuts_of(np.arange(n, 0, -1))
    both = gru.score(flat, cuts, docs, lanes=3)
    assert np.allclose(both, [gru.score(flat, cuts, [d])[0] for d in docs], rtol=1e-5) and len(gru.score(flat, cuts, [])) == 0


def test_training_learns_what_a_unigram_cannot():
    n = 64
    flat = gru.initial(np.full(n, 100), 1)
    rng = np.random.default_rng(0)
    docs = [np.r_[(rng.integers(0, n) + np.arange(60)) % n] for _ in range(3000)]
    cuts = gru.cuts_of(np.full(n, 100))
    t = gru.Trainer(flat, cuts)
    for d in docs[100:]:
        t.feed(d)
    t.flush()
    before, after = gru.score(flat, cuts, docs[:100]).sum(), gru.score(t.flat, cuts, docs[:100]).sum()
    assert after > 0.8 * before


def brute(rows):
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = tok(t)
        out.append((-1 if d is None else d, held(d), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out)


def check(got, rows):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("sent", [65_536, 300])
def test_documents(documents, monkeypatch, sent):
    """Also when most words are too rare to be sent to every executor."""
    monkeypatch.setattr(scoring, "N_SENT", sent)
    monkeypatch.setattr(scoring, "N_WORDS", min(sent, 256))
    got = scoring.score(documents).collect()
    check(got, [(r["doc_id"], r["text"]) for r in documents.collect()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in got)


def test_odd_rows(odd, empty):
    check(scoring.score(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert scoring.score(empty).count() == 0
    only = odd.where("doc_id = 1")  # whatever its fold, and with equal rows
    check(scoring.score(only).collect(), [(r["doc_id"], r["text"]) for r in only.collect()])


def test_scores_are_the_models_word_by_word(documents, monkeypatch):
    """Against the model's equations, one word after the other, with the counts of all training texts taken by hand."""
    monkeypatch.setattr(scoring, "N_WORDS", 200)
    monkeypatch.setattr(scoring, "N_SENT", 1000)
    seen = {}

    def train(docs, lex):
        seen["lex"] = lex
        flat = gru.initial(lex.counts[: lex.own], lex.others)
        seen["flat"] = flat = (flat + np.random.default_rng(3).normal(0, 0.2, len(flat))).astype(np.float32)
        return flat

    monkeypatch.setattr(scoring, "train", train)
    got = {r["doc_id"]: r["score"] for r in scoring.score(documents).collect()}
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    lex, counts = seen["lex"], Counter()
    for d, t in rows.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(scoring.tokens_of(t.encode()))
    own = {w: k for w, k in lex.own_ids.items() if k < lex.own}
    assert sorted(counts[w] for w in own) == sorted(c for _, c in counts.most_common(200))
    rare = [[c for w, c in counts.items() if w not in own and zlib.crc32(w[-2:]) % scoring.RARE == k] for k in range(scoring.RARE)]
    assert lex.others.tolist() == [sum(r) for r in rare]
    p, cuts, n = {k: v.astype(float) for k, v in gru.unpacked(seen["flat"], lex.cuts).items()}, lex.cuts.tolist(), lex.own
    H, sig = gru.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    for d in sorted(rows, key=lambda d: len(rows[d]))[::9]:
        h, x, total = np.zeros(H), n + scoring.RARE, 0.0
        for w in scoring.tokens_of(rows[d].encode()):
            a, g = p["x"][x], h @ p["u"]
            z, r = sig(a[:H] + g[:H]), sig(a[H : 2 * H] + g[H : 2 * H])
            new = np.tanh(a[2 * H :] + r * g[2 * H :])
            h = new + z * (h - new)
            e = h @ p["wc"] + p["bc"]
            e -= np.log(np.exp(e).sum())
            if w in own:
                x = own[w]
                k = next(k for k in range(len(cuts)) if cuts[k + 1] > x)
                inside = p["wo"][cuts[k] : cuts[k + 1]] @ h + p["bo"][cuts[k] : cuts[k + 1]]
                total += e[k] + inside[x - cuts[k]] - np.log(np.exp(inside).sum())
            else:
                k = zlib.crc32(w[-2:]) % scoring.RARE
                x = n + k
                total += e[len(cuts) - 1 + k] + math.log((counts[w] + 1) / (sum(rare[k]) + len(rare[k]) + 1))
        assert abs(got[d] - total / math.log(10)) < 1e-3 * abs(got[d]) + 1e-3
