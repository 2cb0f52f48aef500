"""Near-duplicates by SimHash and a Gray-order hierarchical index.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Distinct
fingerprints meet in cells. Those of one word are cut into ``distance + 3`` blocks, and a cell holds those that
agree in three of them: whatever differs in ``distance`` bits agrees in three blocks, so no link is lost, and
cells of some 27 bits stay small for thousands of millions of texts. Wider ones meet where they agree in a band.
Within a task, cells are sorted by the Gray rank of
the fingerprint, which keeps cells together and neighbours close. Leaves of ``FAN`` neighbours
and the nodes above them hold the bits that all below share, as a mask and a pattern; a search adds up
the differences in newly shared bits while it goes down, and drops a whole group once they pass the
distance. A cell that holds over ``cell_rows`` fingerprints is cut into blocks, and each pair of blocks is
a cell of its own, so hot cells spread. Tasks emit spanning trees, not all pairs; components come from
alternating stars over tables in the shared folder.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; exact copies share a
fingerprint, and only distinct fingerprints are compared; rows with equal ids are documents of their own;
a null id takes part but is never the smallest, unless a component has no other; an empty table gives no
rows; input columns that clash with a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Joined, Member, compared
from .common import plus, release, rows_of, schema_plus, small_batches, table, texts_of, written
from .components import components

SEED = 42
FAN = 8
CELL_ROWS = 20_000
FRONTIER = 1 << 21
#: Blocks that agree in a cell: a distance of 4 makes 7 blocks of 9 or 10 bits, and 35 keys of three.
CHOOSE = 3
SALTS = 16
#: Odd, so that multiples run through all places of a power of two.
STRIDES = (1, 37, 91)
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; one of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k])).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    return np.fromiter((h(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of a hash (its own for word 0), by the splitmix finalizer."""
    if not word:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are 1 in over half of ``h``; sums run in eight byte lanes of a 64-bit word."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):
        part = h[at : at + 255 * 256]
        part = np.concatenate((part, np.zeros(-len(part) % 255, np.uint64))).reshape(-1, 255)
        for k in range(8):
            lanes = ((part >> np.uint64(k)) & LANES).sum(1, dtype=np.uint64)
            counts[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """``docs`` with fp: ``words`` 64-bit fingerprints of the whole text, big-endian."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            fps = []
            for t in texts:
                h = shingle_hashes(t, shingle)
                fps.append(b"".join(majority(_mixed(h, w)).to_bytes(8, "big") for w in range(words)))
            yield plus(batch, (), {"fp": pa.array(fps, pa.binary())})

    return docs.mapInArrow(run, schema_plus(docs, (), "fp binary"))


def band_edges(bits: int, bands: int, width: int | None) -> list[tuple[int, int]]:
    """(first bit, width) of each band, from the top; without ``width`` they share all bits."""
    if width:
        return [(k * width, width) for k in range(bands)]
    cuts = [bits * k // bands for k in range(bands + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def as_words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def rotated(words: np.ndarray, first: int) -> np.ndarray:
    """64 bits from bit ``first`` on, cyclically."""
    n, at, by = words.shape[1], first // 64, np.uint64(first % 64)
    high, low = words[:, at % n], words[:, (at + 1) % n]
    return high if not by else (high << by) | (low >> (np.uint64(64) - by))


def spread(words: np.ndarray, turn: int) -> np.ndarray:
    """The same bits in another order, one for each turn, so that bands of different turns hold different bits."""
    if not turn:
        return words
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    order = np.arange(bits.shape[1]) * STRIDES[turn] % bits.shape[1]
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").astype(np.uint64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Nodes of each level, leaves' entries first: first and last entry, mask of shared bits, pattern of these."""

    def __init__(self, cells: np.ndarray, words: np.ndarray, label: np.ndarray | None = None):
        """Entries sorted by cell, then Gray rank. With labels (integers), only links between two labels are of interest."""
        self.words, self.label = words, label
        least = most = label
        self.same = [label]  # of each node the label that all entries below share, or -1
        n, w = words.shape
        ones = np.full((n, w), ~np.uint64(0))
        self.levels = [(np.arange(n), np.arange(1, n + 1), np.arange(n), ones, words)]
        low = high = words
        cell, first, last = cells, np.arange(n), np.arange(1, n + 1)
        while True:
            new = np.r_[True, cell[1:] != cell[:-1]]
            if new.all() and len(self.levels) > 1:
                break
            place = np.arange(len(cell)) - np.maximum.accumulate(np.where(new, np.arange(len(cell)), 0))
            begin = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
            mask = ~(low ^ high)
            ends = np.r_[begin[1:], len(cell)]
            self.levels.append((first[begin], last[ends - 1], begin, mask, low & mask))
            first, last, cell = first[begin], last[ends - 1], cell[begin]
            self.levels[-1] += (ends,)
            if label is not None:
                least, most = np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)
                self.same.append(np.where(least == most, least, -1))

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of entries a < b of one cell that differ in at most ``distance`` bits, and in how many; groups of one label drop out as a whole."""
        top = len(self.levels) - 1
        first, last, _, mask, pattern, *_ = self.levels[top]
        q = np.arange(len(self.words))
        node = np.searchsorted(last, q, "right")
        acc = np.bitwise_count((self.words[q] ^ pattern[node]) & mask[node]).sum(1, dtype=np.int64)
        stack = [(top, q[a : a + FRONTIER // FAN], node[a : a + FRONTIER // FAN], acc[a : a + FRONTIER // FAN]) for a in range(0, len(q), FRONTIER // FAN)]
        while stack:
            level, q, node, acc = stack.pop()
            if level == 0:
                if len(q):
                    yield q, node, acc
                continue
            if len(q) > FRONTIER // FAN:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], acc[:half]), (level, q[half:], node[half:], acc[half:])]
                continue
            begin, ends = self.levels[level][2], self.levels[level][5]
            times = ends[node] - begin[node]
            child = np.repeat(begin[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            q, above, acc = np.repeat(q, times), np.repeat(node, times), np.repeat(acc, times)
            later = self.levels[level - 1][1][child] - 1 > q if level > 1 else child > q
            if self.label is not None:
                later &= self.same[level - 1][child] != self.label[q]
            q, above, acc, child = q[later], above[later], acc[later], child[later]
            fresh = self.levels[level - 1][3][child] & ~self.levels[level][3][above]
            acc = acc + np.bitwise_count((self.words[q] ^ self.levels[level - 1][4][child]) & fresh).sum(1, dtype=np.int64)
            near = acc <= distance
            stack.append((level - 1, q[near], child[near], acc[near]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The least member of each entry's component, by hooking and pointer jumping on arrays."""
    root = np.arange(n)
    for a, b, *_ in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _cells(edges: list[tuple[int, int]], turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = spread(as_words(batch.column("fp").to_pylist()), turn)
            for k, (first, width) in enumerate(edges):
                prefix = (rotated(words, first) >> np.uint64(64 - width)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"cell": pa.array((k << 16 | prefix) << 40)} | {n: batch.column(n) for n in batch.schema.names})

    return run


def block_masks(distance: int, choose: int) -> list[int]:
    """Masks of each choice of ``choose`` among ``distance + choose`` blocks of 64 bits; what differs in ``distance`` bits agrees under one."""
    blocks = [sum(1 << (63 - b) for b in range(first, first + width)) for first, width in band_edges(64, distance + choose, None)]
    return [sum(some) for some in combinations(blocks, choose)]


def _block_cells(masks: list[int]):
    """A cell is a number made of a mask and the bits under it; where two make the same number, they share a cell and nothing is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = as_words(batch.column("fp").to_pylist())[:, 0]
                for k, mask in enumerate(masks, 1):
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(_mixed(words & np.uint64(mask), k).view(np.int64))} | {n: batch.column(n) for n in batch.schema.names})

    return run


def _linking(distance: int):
    """Spanning trees of the links of a task's cells; where fingerprints have labels, of the links between labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps, labels = [], [], []
        for batch in batches:
            cells.append(batch.column("cell").to_numpy())
            fps.append(as_words(batch.column("fp").to_pylist()))
            if "label" in batch.schema.names:
                labels.append(as_words(batch.column("label").to_pylist()))
        if not sum(map(len, cells)):
            return
        cell, words = np.concatenate(cells), np.concatenate(fps)
        order = np.lexsort((gray_rank(words[:, 0]), cell))
        names, label = np.unique((np.concatenate(labels) if labels else words)[order], axis=0, return_inverse=True)
        label = label.ravel()
        links = GrayIndex(cell[order], np.ascontiguousarray(words[order]), label if labels else None).links(distance)
        # names are sorted, so trees hang from their least one
        root = roots(len(names), ((label[a], label[b]) for a, b, _ in links))
        child = np.flatnonzero(root != np.arange(len(root)))
        for a in range(0, len(child), 10_000):
            u, v = (([x.tobytes() for x in names[i].astype(">u8")]) for i in (child[a : a + 10_000], root[child[a : a + 10_000]]))
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})
        release()

    return run


def linked(fps: DataFrame, distance: int = 4, words: int = 1, bands: int | None = None, width: int | None = None, turn: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """u, v (binary fingerprints): spanning trees of the links between the distinct fingerprints of ``fps`` (fp).

    With a label (binary) for each fingerprint, they are trees of labels, of the links between different ones. Fingerprints
    of one word without ``bands`` meet under block masks, so no link is lost; others meet in the bands of one ``turn``.
    """
    held = [n for n in ("fp", "label") if n in fps.columns]
    cut = _cells(band_edges(64 * words, bands or distance + 1, width), turn) if bands or words > 1 else _block_cells(block_masks(distance, CHOOSE))
    cells = fps.select(*held).distinct().mapInArrow(cut, "cell bigint, " + ", ".join(f"{n} binary" for n in held))
    # a table of the shared folder, so that its join knows its size and broadcasts it only if it is small
    heavy = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("cell", F.ceil(2 * F.col("n") / cell_rows).cast("bigint").alias("blocks")))
    met = cells.join(heavy, "cell", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    others = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).alias("other")
    met = met.select("cell", *held, "own", others).where("own IS NULL OR own <> other")
    key = F.when(F.col("own").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
    return met.select(key.alias("cell"), *held).repartition("cell").mapInArrow(_linking(distance), "u binary, v binary")


def groups(fps: DataFrame, turns: int = 1, **search) -> DataFrame:
    """fp, root (binary): the component of each fingerprint that has a link to a lesser one.

    After each turn, what has been joined goes by one label, so later turns look for links between labels only.
    """
    labels = None
    for turn in range(turns):
        given = fps if labels is None else fps.select("fp").distinct().join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        found = components(linked(given, turn=turn, **search)).select(F.col("u").alias("fp"), F.col("root").alias("label"))
        if labels is None:
            labels = found
            continue
        further = found.select(F.col("fp").alias("label"), F.col("label").alias("to")).repartition(F.xxhash64("label", F.lit(1)))
        labels = written(labels.join(further, "label", "left").select("fp", F.coalesce("to", "label").alias("label")).unionByName(found))
    return labels.withColumnRenamed("label", "root")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id of its component) for each row of ``docs``."""
    fps = written(fingerprints(docs.select("doc_id", "text"), shingle).drop("text"))
    each = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked_to = groups(fps, distance=distance)
    members = linked_to.unionByName(linked_to.select(F.col("root").alias("fp"), "root").distinct()).join(each, "fp")
    # salted, so that a component of any size spreads
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")
    least = members.groupBy("root").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    found = members.select("fp", "root", salt).join(least, ["root", "salt"]).select("fp", "component_id")
    ids = written(each.join(found, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")))
    return fps.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: For whole documents, five-word shingles of similarity 0.8. An angle of acos(2 * 0.8 / 1.8) makes 0.151 of 256 bits
#: differ, 39 give or take 6, so 998 in 1000 such pairs are within 55. Some band of 57 (19 in each of three orders of the
#: bits) is equal with a probability of 1 - (1 - 0.849 ** 13) ** 57 = 0.999. What is within is then compared itself.
SHINGLE, WORDS, DISTANCE, BANDS, BAND_BITS, TURNS, LEAST = 5, 4, 55, 19, 13, 3, 0.8


def alike(a: set[int], b: set[int], least: float) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``least``; two empty ones do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of ``pairs`` (u, v: fingerprints) whose texts (``texts``: fp, text) are alike."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ones in rows_of(batches, "one"):
            others = texts_of(batch, "other")
            known: dict[bytes, set[int]] = {}
            sets = ([known[t] if t in known else known.setdefault(t, set(shingle_hashes(t, shingle).tolist())) for t in side] for side in (ones, others))
            keep = pa.array([alike(a, b, least) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    one, other = (texts.select(F.col("fp").alias(at), F.col("text").alias(name)) for at, name in (("u", "one"), ("v", "other")))
    return pairs.join(other, "v").join(one, "u").select("u", "v", "one", "other").mapInArrow(run, "u binary, v binary")


class Comparison:
    """Exact comparison of the texts of one cell: pairs of different labels that the index finds, nearest first, until all that are alike are joined."""

    def __init__(self, distance: int, shingle: int, least: float):
        self.distance, self.shingle, self.least = distance, shingle, least

    def __call__(self, a: list[Member], b: list[Member] | None) -> list[tuple[bytes, bytes]]:
        members, side = a + (b or []), np.array([0] * len(a) + [1] * len(b or []))
        words = as_words([m["u"] for m in members])
        order = np.argsort(gray_rank(words[:, 0]), kind="stable")
        known: dict[bytes, int] = {}
        label = np.array([known.setdefault(m["label"], len(known)) for m in members])[order]
        side, words, joined, sets, out = side[order], np.ascontiguousarray(words[order]), Joined(), {}, []
        names = list(known)

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingle_hashes((members[k]["payload"] or b""), self.shingle))
            return sets[k]

        for one, other, bits in GrayIndex(np.zeros(len(members), np.int64), words, label).links(self.distance):
            if b is not None:  # two blocks meet; each has a cell for its own pairs
                across = side[one] != side[other]
                one, other, bits = one[across], other[across], bits[across]
            nearest = np.argsort(bits, kind="stable")
            one, other = one[nearest], other[nearest]
            for i, j, la, lb in zip(*(x.tolist() for x in (order[one], order[other], label[one], label[other])), strict=True):
                if joined.root(names[la]) != joined.root(names[lb]) and similar_sets(shingles(i), shingles(j), self.least):
                    joined.join(names[la], names[lb])
                    out.append((members[i]["u"], members[j]["u"]))
        return out


def similar_sets(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """``alike`` of sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both >= least * (len(a) + len(b) - both)


def similar(fps: DataFrame, each: DataFrame, shingle: int, least: float, **search) -> DataFrame:
    """u, v: links between alike texts of ``fps`` (fp, text, _row), enough of them to join all that any such links join.

    Fingerprints within the distance make groups. Each member is compared with its group's root; those alike are the group's
    core. Where others are left, blocks of these meet each other and blocks of the core (see ``blocks``): a text is stored
    once in its block, so what is written grows with the group, and pairs are never rows of a table.
    ``each`` has the row (low._row) whose text stands for a fingerprint.
    """
    near = written(groups(fps, **search))
    members = near.unionByName(near.select(F.col("root").alias("fp"), "root").distinct())
    rows = written(members.join(each, "fp").select("fp", "root", F.col("low._row").alias("_row")))
    texts = written(fps.select("_row", "text").join(rows.select("fp", "_row").hint("merge"), "_row").select("fp", "text"))
    first = written(confirmed(near.select(F.col("fp").alias("u"), F.col("root").alias("v")), texts, shingle, least))
    core = first.select(F.col("u").alias("fp"), F.col("v").alias("label"))
    left = written(rows.join(core, "fp", "left").select("fp", "root", F.coalesce("label", "fp").alias("label")).withColumn("rest", F.col("label") != F.col("root")))
    # the root has been compared with every member, so a group needs cells only where two others are left
    some = left.where("fp <> root").groupBy("root").agg(F.max("rest").alias("any"), F.count("*").alias("n")).where("any AND n > 1").select("root")
    held = left.where("fp <> root").join(some.repartition(F.xxhash64("root", F.lit(1))), "root", "left_semi").join(texts, "fp")
    held = held.select(F.col("root").alias("grp"), F.col("fp").alias("u"), "label", "rest", F.col("text").cast("binary").alias("payload"))
    return first.unionByName(compared(held, Comparison(search["distance"], shingle, least)))


def deduplicated(
    docs: DataFrame, shingle: int = SHINGLE, words: int = WORDS, distance: int = DISTANCE, bands: int | None = BANDS, width: int | None = BAND_BITS, turns: int = TURNS, least: float = LEAST
) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with one row of each component: that of the smallest doc_id.

    Components are of links between texts whose shingles have a similarity of ``least`` or more; fingerprints only find them.
    Rows of one fingerprint are one text. Rows of one id and component are equal but for their order; one of them stays.
    Rows without words are one component, as in ``near_duplicates``.
    """
    names = docs.columns
    docs = docs.withColumnsRenamed({n: f"_kept_{k}" for k, n in enumerate(names) if n not in ("doc_id", "text")})  # none clashes then
    fps = written(fingerprints(docs, shingle, words).withColumn("_row", F.monotonically_increasing_id()))
    each = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("low"))
    links = similar(fps, each, shingle, least, distance=distance, words=words, bands=bands, width=width, turns=turns)
    root = each.join(components(links).select(F.col("u").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = root.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low._row").alias("_row"))
    # texts move once, at every size alike: how many rows stay follows the input, so they are never broadcast
    return fps.join(kept.hint("merge"), "_row", "left_semi").select(*(n if n in ("doc_id", "text") else F.col(f"_kept_{k}").alias(n) for k, n in enumerate(names)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
