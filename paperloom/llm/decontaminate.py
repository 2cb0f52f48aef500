"""Benchmark decontamination by Wu-Manber search over words.

Every window of ``size`` consecutive words of a benchmark item is a pattern; an item of fewer words
is one pattern. Patterns of one length share an index. Its shift table holds, for each block of two
words, how far the search may move before a pattern could end there; an unknown block moves it by
all but one word of a pattern. A block that ends a pattern has a bucket (suffix hash), split by the
patterns' first block (prefix hash); only those patterns are compared word by word.

Tables are flat arrays of some 7 bytes a character of the benchmark. It is read in blocks of at most ``block_chars``
characters (one item may be longer), each sent on its own. Documents are read once and never shuffled or rewritten: a worker
holds the tables of one block at a time, and each batch of documents meets all blocks in turn.

Edge cases: null texts have no words; items without words have no window; repeated rows are judged
row by row; an item_id on several rows is one item; a null item_id marks words but is not listed; an
empty table gives no rows and an empty benchmark no hits; input columns that clash with a result
column give way to it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, rows_of, schema_plus, sliced, small_batches, table

SIZE = 10
BLOCK_CHARS = 8_000_000
#: Lower-cases A-Z and makes every ASCII byte that is no word character a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Index:
    """Wu-Manber tables for patterns of one length ``m``, held in flat arrays over the items' own words.

    The shift table is hashed: blocks that share a slot only make a shift smaller. A pattern is a place in ``stream``;
    its key is its last block's hash, then its first block's. ``names`` are the ids that ``owners`` point to.
    """

    def __init__(self, m: int, items: list[tuple[str | None, list[bytes]]]):
        self.m, self.b = m, min(2, m)
        words = [w for _, ws in items for w in ws]
        self.stream = b" ".join(words)
        self.offsets = array("Q", bytes(8)) + array("Q", np.cumsum(np.fromiter(map(len, words), np.uint64, len(words)) + np.uint64(1), dtype=np.uint64).tobytes())
        last = words[:1] + words[:-1] if self.b == 2 else None
        hashes = np.fromiter((crc32(w, crc32(v)) for v, w in zip(last, words, strict=True)) if last is not None else map(crc32, words), np.uint32, len(words))
        counts = np.array([len(ws) for _, ws in items])
        begins = np.cumsum(counts) - counts
        starts = np.concatenate([np.arange(a, a + n - m + 1) for a, n in zip(begins.tolist(), counts.tolist(), strict=True)])
        owners = np.repeat(np.arange(len(items)), counts - m + 1)
        self.mask = (1 << min(24, max(12, (4 * len(words)).bit_length()))) - 1
        self.most = min(255, m - self.b + 1)
        shift = np.full(self.mask + 1, self.most, np.uint8)
        for j in range(self.b, m + 1):  # shifts fall with j, so the least one stays
            shift[hashes[starts + j - 1] & np.uint32(self.mask)] = min(255, m - j)
        self.shift = shift.tobytes()
        keys = hashes[starts + m - 1].astype(np.uint64) << np.uint64(32) | hashes[starts + self.b - 1]
        order = np.argsort(keys, kind="stable")
        keys, starts, owners = keys[order], starts[order], owners[order]
        first = self._first_of_equals(keys, starts)
        kept = np.flatnonzero(first == np.arange(len(first)))
        self.names = [None if name is None else str(name) for name, _ in items]
        named = np.array([n is not None for n in self.names])[owners]
        pairs = np.unique(np.stack([np.searchsorted(kept, first[named]), owners[named]]), axis=1)
        self.keys, self.starts = array("Q", keys[kept].tobytes()), array("Q", starts[kept].astype(np.uint64).tobytes())
        self.bounds = array("Q", np.searchsorted(pairs[0], np.arange(len(kept) + 1)).astype(np.uint64).tobytes())
        self.owners = array("I", pairs[1].astype(np.uint32).tobytes())

    def _first_of_equals(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each pattern (in order of keys) the place of the first with the same words."""
        first = np.arange(len(keys))
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, e in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist(), strict=True):
            seen: dict[bytes, int] = {}
            for k in range(a, e):
                first[k] = seen.setdefault(self._words(int(starts[k])), k)
        return first

    def _words(self, start: int) -> bytes:
        return self.stream[self.offsets[start] : self.offsets[start + self.m] - 1]

    def find(self, words: list[bytes], inside: np.ndarray, found: set[str], met: set[int]) -> None:
        """Marks the words of every occurrence in ``inside`` and adds its items to ``found``; patterns in ``met`` are in it."""
        m, two, shift, mask, keys, at, n = self.m, self.b == 2, self.shift, self.mask, self.keys, self.m - 1, len(words)
        while at < n:
            end = crc32(words[at], crc32(words[at - 1])) if two else crc32(words[at])
            move = shift[end & mask]
            if move:
                at += move
                continue
            first = at - m + 1
            key = end << 32 | (crc32(words[first + 1], crc32(words[first])) if two else end)
            k = bisect_left(keys, key)
            while k < len(keys) and keys[k] == key:
                if self._words(self.starts[k]) == b" ".join(words[first : at + 1]):
                    inside[first : at + 1] = True
                    if k not in met:
                        met.add(k)
                        found.update(self.names[o] for o in self.owners[self.bounds[k] : self.bounds[k + 1]])
                    break
                k += 1
            at += 1

    def nbytes(self) -> int:
        return len(self.stream) + len(self.shift) + sum(x.itemsize * len(x) for x in (self.offsets, self.keys, self.starts, self.bounds, self.owners))


def indexes(items: Iterable[tuple[object, str | None]], size: int = SIZE) -> list[Index]:
    by: dict[int, list[tuple[str | None, list[bytes]]]] = defaultdict(list)
    for item, text in items:
        words = words_of((text or "").encode())
        if words:
            by[min(size, len(words))].append((None if item is None else str(item), words))
    return [Index(m, of) for m, of in sorted(by.items())]


def searched(text: bytes, tables: list[Index], found: set[str]) -> np.ndarray:
    """Whether each word of ``text`` lies in an occurrence; adds the items to ``found``.

    A long text is searched slice by slice. A slice begins with the words before it that an occurrence may begin with.
    """
    over = max((t.m for t in tables), default=1) - 1
    marks, before = [np.zeros(0, bool)], []
    met: list[set[int]] = [set() for _ in tables]
    for piece in sliced(text, BREAK):
        words = before + words_of(piece)
        inside = np.zeros(len(words), bool)
        for t, known in zip(tables, met, strict=True):
            t.find(words, inside, found, known)
        back = len(before)
        for m in reversed(marks):  # the words before belong to the slices before
            n = min(back, len(m))
            if n:
                m[len(m) - n :] |= inside[back - n : back]
                back -= n
        marks.append(inside[len(before) :])
        before = words[max(0, len(words) - over) :] if over else []
    return np.concatenate(marks)


def blocks(bench: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of ``block_chars`` characters (one item may be longer), without collecting the table."""
    block, chars = [], 0
    for item, text in bench.select("item_id", "text").toLocalIterator():
        if block and chars + len(text or "") > block_chars:
            yield block
            block, chars = [], 0
        block.append((item, text))
        chars += len(text or "")
    yield block


def _loaded(sent: list[Broadcast]) -> Iterator[list[Index]]:
    """The indexes of each block in turn; of several blocks only one is in memory."""
    for one in sent:
        yield one.value
        if len(sent) > 1:
            vars(one).pop("_value", None)  # the worker's copy; the next look reads the executor's file again


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = SIZE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), spans (merged word ranges, end exclusive) and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = schema_plus(docs, (), ["n_words bigint", "n_hit bigint", "items array<string>", "spans array<struct<start:bigint,end:bigint>>"])
    sent = [spark.sparkContext.broadcast(indexes(block, size)) for block in blocks(bench, block_chars)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            found: list[set[str]] = [set() for _ in texts]
            inside: list[np.ndarray | None] = [None] * len(texts)
            for tables in _loaded(sent):
                for k, text in enumerate(texts):
                    marks = searched(text, tables, found[k])
                    inside[k] = marks if inside[k] is None else inside[k] | marks
            out = []
            for marks, items in zip(inside, found, strict=True):
                edges = np.flatnonzero(np.diff(np.r_[False, marks, False])).tolist()
                out.append((len(marks), int(marks.sum()), sorted(items), [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            cols = zip(*out, strict=True)
            yield plus(batch, (), {n: pa.array(c, t) for n, c, t in zip(("n_words", "n_hit", "items", "spans"), cols, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span)), strict=True)})

    return docs.mapInArrow(search, schema).withColumn("contaminated", F.col("n_hit") > 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
