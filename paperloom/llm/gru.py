"""A gated recurrent language model in numpy.

Words ``0 .. n_words - 1`` are in order of frequency; classes are runs of them with equal sums of the square
roots of their counts, so frequent words, which cost most, have small classes. Rare classes follow, one id each
from ``n_words`` on, for all other words; the last row of the input table is the start of a document. ``cuts`` says
where classes begin and where the last one ends. The probability of a word is that of its class, given the state,
times its probability in the class. Training runs many streams of text side by side by truncated
backpropagation: windows of ``STEPS`` tokens, the state carried from one to the next and cleared where a
document starts. Scoring carries each document's state from its first token to its last.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
CLASSES = 24
STREAMS, STEPS = 512, 16
RATE = 0.01


def cuts_of(counts: np.ndarray) -> np.ndarray:
    """Where classes begin, and the number of words; no class is empty."""
    if not len(counts):
        return np.zeros(1, np.int64)
    sums = np.cumsum(np.sqrt(counts))
    inner = np.searchsorted(sums, sums[-1] * np.arange(1, CLASSES) / CLASSES) + 1
    return np.unique(np.r_[0, np.minimum(inner, len(counts)), len(counts)])


def shapes(cuts: np.ndarray, rare: int = 1) -> dict[str, tuple[int, ...]]:
    """Parameters: input table (words, rare classes, start), recurrence, class and word outputs with biases."""
    n, c = int(cuts[-1]), len(cuts) - 1
    return {"x": (n + rare + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, c + rare), "bc": (c + rare,), "wo": (n, HIDDEN), "bo": (n,)}


def size(cuts: np.ndarray, rare: int = 1) -> int:
    return sum(int(np.prod(s)) for s in shapes(cuts, rare).values())


def rare_of(flat: np.ndarray, cuts: np.ndarray) -> int:
    """How many rare classes these parameters have."""
    none = size(cuts, 0)
    return (len(flat) - none) // (size(cuts, 1) - none)


def unpacked(flat: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {"cuts": cuts}, 0
    for name, shape in shapes(cuts, rare_of(flat, cuts)).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, others: int | np.ndarray, seed: int = 7) -> np.ndarray:
    """Small random weights; biases give each word and each rare class (``others``: their counts) its share."""
    cuts, others = cuts_of(counts), np.atleast_1d(others)
    flat = np.random.default_rng(seed).normal(0, 0.1, size(cuts, len(others))).astype(np.float32)
    p = unpacked(flat, cuts)
    sums = [counts[a:b].sum() + 1.0 for a, b in zip(cuts, cuts[1:], strict=False)]
    p["bc"][:] = np.log(np.r_[sums, others + 1.0])
    p["bc"][:] -= p["bc"].max()
    for a, b in zip(cuts, cuts[1:], strict=False):
        p["bo"][a:b] = np.log(counts[a:b] + 1.0) - np.log(counts[a:b].max() + 1.0)
    return flat


def _gates(ut: np.ndarray, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Next state, update and reset gates, candidate and its recurrent part, from the state and the inputs' rows of the table.

    All have a column for each stream, so each gate is one run of memory.
    """
    g = ut @ h
    zr = a[: 2 * HIDDEN] + g[: 2 * HIDDEN]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    z, r, gn = zr[:HIDDEN], zr[HIDDEN:], g[2 * HIDDEN :]
    n = r * gn
    n += a[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, gn


def _output(p: dict[str, np.ndarray], hs: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each target; with ``grads``, also fills them and returns the states' gradient (of the mean loss).

    States lie in (-1, 1), so logits stay small enough for exp as they are.
    """
    cuts, n = p["cuts"], len(y)
    c = len(cuts) - 1
    rare = len(p["bc"]) - c
    cls = np.repeat(np.arange(c + rare, dtype=np.int16), np.r_[np.diff(cuts), np.ones(rare, np.int64)])[y]
    e = hs @ p["wc"]
    e += p["bc"]
    rows = np.arange(n)
    logp = e[rows, cls]
    np.exp(e, out=e)
    total = e.sum(1)
    logp -= np.log(total)
    dh = None
    if grads is not None:
        e *= (np.float32(1 / n) / total)[:, None]
        e[rows, cls] -= np.float32(1 / n)
        grads["wc"][:], grads["bc"][:] = hs.T @ e, e.sum(0)
        dh = e @ p["wc"].T
    order = np.argsort(cls, kind="stable")
    runs = np.searchsorted(cls[order], np.arange(c + 1))
    for k in range(c):
        at = order[runs[k] : runs[k + 1]]
        if not len(at) or cuts[k + 1] - cuts[k] == 1:  # the only word of its class
            continue
        of = slice(cuts[k], cuts[k + 1])
        own, inside, place = hs[at], y[at] - cuts[k], np.arange(len(at))
        e = own @ p["wo"][of].T
        e += p["bo"][of]
        lp = e[place, inside]
        np.exp(e, out=e)
        total = e.sum(1)
        logp[at] += lp - np.log(total)
        if grads is not None:
            e *= (np.float32(1 / n) / total)[:, None]
            e[place, inside] -= np.float32(1 / n)
            grads["wo"][of], grads["bo"][of] = e.T @ own, e.sum(0)
            dh[at] += e @ p["wo"][of]
    return logp, dh


class Trainer:
    """Adam over windows; ``feed`` takes the ids of whole documents, each ending in the end word."""

    def __init__(self, flat: np.ndarray, cuts: np.ndarray, rate: float = RATE):
        self.flat, self.cuts, self.start, self.rate = flat.astype(np.float32).copy(), cuts, int(cuts[-1]) + rare_of(flat, cuts), rate
        self.p = unpacked(self.flat, cuts)
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.loss = 0.0

    def feed(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= STREAMS * STEPS * 24:
            self.flush()

    def flush(self) -> None:
        """Trains on what waits: split evenly over the streams, the last incomplete step left for the next call."""
        if not self.waiting:
            return
        y = np.concatenate(self.waiting)
        first = np.zeros(len(y), bool)
        first[np.cumsum([0, *map(len, self.waiting[:-1])])] = True
        x = np.r_[self.start, y[:-1]].astype(np.int32)
        x[first] = self.start
        streams = max(1, min(STREAMS, len(y) // STEPS))
        length = -(-len(y) // streams)
        short = streams * length - len(y)  # the last stream is filled up with the first tokens again
        x, y, first = (np.r_[a, np.resize(a, short)].reshape(streams, length).T for a in (x, y, first))
        keep = (~first).astype(np.float32)
        h = np.zeros((streams, HIDDEN), np.float32)
        for a in range(0, length, STEPS):
            h = self._window(x[a : a + STEPS], y[a : a + STEPS], keep[a : a + STEPS], h)
        self.tokens += self.held
        self.waiting, self.held = [], 0

    def _window(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        steps, streams = x.shape
        p, h = self.p, np.ascontiguousarray(h.T)
        rows, ut = np.ascontiguousarray(p["x"].T), np.ascontiguousarray(p["u"].T)
        before, z, r, n, gn, hs = (np.empty((steps, HIDDEN, streams), np.float32) for _ in range(6))
        for t in range(steps):
            h = h * keep[t]
            before[t] = h
            h, z[t], r[t], n[t], gn[t] = _gates(ut, h, rows.take(x[t], axis=1))
            hs[t] = h
        tall = lambda a: np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(-1, a.shape[1])
        flat = np.zeros_like(self.flat)
        grads = unpacked(flat, self.cuts)
        logp, dhs = _output(p, tall(hs), y.ravel(), grads)
        self.loss = -float(logp.mean())
        dhs = np.ascontiguousarray(dhs.reshape(steps, streams, HIDDEN).transpose(0, 2, 1))
        # what turns a state's gradient into those of the gates does not depend on it, so it is made for all steps at once
        to_n = (1 - z) * (1 - n * n)
        to_z = (before - n) * z * (1 - z)
        to_r = gn * r * (1 - r)
        da = np.empty((steps, 3 * HIDDEN, streams), np.float32)
        dg = np.empty_like(da)
        back = np.zeros((HIDDEN, streams), np.float32)
        u = np.ascontiguousarray(p["u"])
        for t in range(steps - 1, -1, -1):
            dh = dhs[t] + back
            dn = dh * to_n[t]
            np.multiply(dh, to_z[t], out=da[t, :HIDDEN])
            np.multiply(dn, to_r[t], out=da[t, HIDDEN : 2 * HIDDEN])
            da[t, 2 * HIDDEN :] = dn
            dg[t, : 2 * HIDDEN] = da[t, : 2 * HIDDEN]
            np.multiply(dn, r[t], out=dg[t, 2 * HIDDEN :])
            dh *= z[t]
            dh += u @ dg[t]
            back = dh * keep[t]
        grads["u"][:] = np.matmul(before, dg.transpose(0, 2, 1)).sum(0)
        ids = x.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grads["x"][ids[begin]] = np.add.reduceat(tall(da)[order], begin)
        self.t += 1
        self.m += (flat - self.m) * np.float32(0.1)
        self.v += (flat * flat - self.v) * np.float32(0.01)
        step = self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        self.flat -= np.float32(step) * self.m / (np.sqrt(self.v) + np.float32(1e-8))
        return h.T


def score(flat: np.ndarray, cuts: np.ndarray, docs: list[np.ndarray], lanes: int = STREAMS) -> np.ndarray:
    """Natural log-probability of each document (ids with their end word): classes, and words in theirs."""
    p, start = unpacked(flat, cuts), int(cuts[-1]) + rare_of(flat, cuts)
    total = np.zeros(len(docs))
    if not docs:
        return total
    # documents go, longest first, to the lane that ends soonest; lanes then run side by side, longest first,
    # and are few enough for the longest document not to leave most of the table empty
    sizes = np.array([len(d) for d in docs])
    ends = [(0, k) for k in range(max(1, min(lanes, len(docs), int(2 * sizes.sum() // sizes.max()))))]
    queue: list[list[int]] = [[] for _ in ends]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, k = heapq.heappop(ends)
        queue[k].append(d)
        heapq.heappush(ends, (n + int(sizes[d]), k))
    queue.sort(key=lambda q: -sum(sizes[d] for d in q))
    lens = np.array([sum(sizes[d] for d in q) for q in queue])
    steps = int(lens[0])
    y = np.zeros((len(queue), steps), np.int32)
    x = np.zeros_like(y)
    own = np.zeros_like(y)
    for k, q in enumerate(queue):
        at = 0
        for d in q:
            y[k, at : at + sizes[d]] = docs[d]
            x[k, at] = start
            x[k, at + 1 : at + sizes[d]] = docs[d][:-1]
            own[k, at : at + sizes[d]] = d
            at += sizes[d]
    x, y, own = (np.ascontiguousarray(a.T) for a in (x, y, own))
    active = np.searchsorted(-lens, -np.arange(steps), "left")  # lanes longer than t
    h = np.zeros((HIDDEN, len(queue)), np.float32)
    rows, ut = np.ascontiguousarray(p["x"].T), np.ascontiguousarray(p["u"].T)
    fresh = x == start
    a = 0
    while a < steps:
        b, count = a, 0
        while b < steps and (b == a or count + active[b] <= 1 << 14):
            count += int(active[b])
            b += 1
        hs, at = np.empty((count, HIDDEN), np.float32), 0
        for t in range(a, b):
            m = int(active[t])
            h = h[:, :m] * ~fresh[t, :m]
            h = _gates(ut, h, rows.take(x[t, :m], axis=1))[0]
            hs[at : at + m] = h.T
            at += m
        ys = np.concatenate([y[t, : active[t]] for t in range(a, b)])
        logp, _ = _output(p, hs, ys, None)
        total += np.bincount(np.concatenate([own[t, : active[t]] for t in range(a, b)]), logp, len(docs))
        a = b
    return total
