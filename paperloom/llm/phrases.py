"""Phrases whose words come together more often than by chance, mined level by level with hashed buckets.

Words are runs without blanks and tabs inside pieces between marks and line ends. Pass k counts the phrases of k
words exactly, and while it does so counts those of k + 1 words in hashed buckets. What it counts exactly has passed
three tests: both of its parts of k - 1 words are frequent (Apriori; a bitmap of hashes of the frequent ones, by which
no frequent phrase is lost), and its bucket reached the least count (PCY and DHP; a bitmap of buckets). What gets into
buckets has both parts of k words among the phrases that pass k counts. Counters stop at 255, so a task's are as
many bytes as buckets, compressed; Spark adds them chunk by chunk in two steps. Only bitmaps, whose sizes are
parameters, reach the driver and are broadcast. When an input outgrows them they let more through, which costs time,
but the counts are exact at every size: phrases of a task are told apart by their words, and Spark sums them by
their text, with partial sums first.

A phrase that starts or ends a longer one is at least as frequent, and what lies in a longer phrase of equal frequency
also lies in one of its length plus one of that frequency; so a look at those is enough to drop it.

Edge cases: a null text is an empty one; a null lang is ``und``; rows with equal ids each count; texts longer than a
slice are cut between words and windows reach over the cut; ties are ranked by the phrase's bytes; an empty table, or
one without a phrase that is frequent enough, gives no rows; no other column of the input is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import has_bit, hash_bits, release, removed, rows_of, sliced, small_batches, table, written

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Logarithms: buckets of a pass (a byte each in a task), bits of the bitmap of frequent phrases, buckets of a chunk.
BUCKET_BITS, FREQUENT_BITS, CHUNK_BITS = 22, 26, 16
#: Phrases and words that a task holds before it hands on their counts.
HELD, VOCABULARY = 1 << 20, 1 << 19
SALTS = 32
MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
BETWEEN = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
CODEC = "zstd"


def finished(h: np.ndarray, seed: int) -> np.ndarray:
    """All bits of a hash depend on all of its bits and on the seed."""
    z = h + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Words(dict):
    """Numbers of words as they come; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """Of the words of a text without upper-case letters whose marks are all ``.``."""
        words = text.replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hash(self) -> np.ndarray:
        known = len(self.hashes)
        if known < len(self):
            new = list(self)[known:]
            self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))))
        return self.hashes


class Pass:
    """Counts phrases of ``k`` words and buckets of ``k + 1`` in one task."""

    def __init__(self, k: int, longest: int, sizes: tuple[int, int], frequent: Broadcast | None, buckets: Broadcast | None):
        self.k, self.more, (self.bucket_bits, self.frequent_bits) = k, k < longest, sizes
        self.frequent, self.buckets = frequent, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.words, self.rows, self.held, self.into, self.waiting = Words(), {}, 0, [], 0
        self.counters = np.zeros(1 << self.bucket_bits if self.more else 0, np.uint8)
        for batch, texts in rows_of(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                carry = np.empty(0, np.int64)
                for part in sliced(b"\n".join(some), BETWEEN):
                    ids = np.concatenate((carry, self.words.numbers(part.lower().translate(MARKS))))
                    self.windows(lang, ids, len(carry))
                    carry = ids[-self.k :]
                    if self.held >= HELD or len(self.words) >= VOCABULARY:
                        yield from self.counted()
                        self.words, carry = self.restarted(carry)
        yield from self.counted()
        if self.more:
            self.count_buckets()
            yield from self.chunks()
        release()

    def restarted(self, carry: np.ndarray) -> tuple[Words, np.ndarray]:
        old, new = list(self.words), Words()
        return new, np.array([new[old[i]] for i in carry.tolist()], np.int64)

    def windows(self, lang: str, ids: np.ndarray, known: int) -> None:
        """``known`` ids at the front have been seen: windows must reach beyond them."""
        k, n = self.k, len(ids)
        if n < k:
            return
        seed, word = xxhash.xxh64_intdigest(lang.encode()), self.words.hash()[ids]
        whole = np.convolve(ids == 0, np.ones(k, np.int64))[k - 1 : n] == 0 if k > 1 else ids != 0
        whole[: max(0, known - k + 1)] = False
        short = reduce(lambda h, j: h * FACTOR + word[j : n - k + 2 + j], range(1, k - 1), word[: n - k + 2]) if k > 1 else None
        h = short[:-1] * FACTOR + word[k - 1 :] if k > 1 else word
        at = np.flatnonzero(whole)
        if k > 1:
            at = at[has_bit(self.buckets.value, self.bucket_bits, finished(h[at], seed))]
            at = at[has_bit(self.frequent.value, self.frequent_bits, finished(short[at], seed))]
            at = at[has_bit(self.frequent.value, self.frequent_bits, finished(short[at + 1], seed))]
        self.rows.setdefault(lang, []).append((ids[at] if k == 1 else ids[at[:, None] + np.arange(k)], finished(h[at], seed)))
        self.held += len(at)
        if self.more and n > k:
            passed = np.zeros(n - k + 1, bool)
            passed[at] = True
            if known:  # windows that end inside the known part were tested with the slice before; the last of them starts a longer one here
                first = max(0, known - k)
                passed[first] |= self.passed(lang, ids[first : first + k], seed)
            at = np.flatnonzero(passed[:-1] & passed[1:])
            if len(at):
                self.into.append((finished(h[at] * FACTOR + word[at + k], seed) >> np.uint64(64 - self.bucket_bits)).astype(np.int32))
                self.waiting += len(at)
                if self.waiting >= HELD:
                    self.count_buckets()

    def passed(self, lang: str, ids: np.ndarray, seed: int) -> bool:
        """The tests of one window."""
        if len(ids) < self.k or (ids == 0).any():
            return False
        if self.k == 1:
            return True
        word = self.words.hash()[ids]
        h = lambda w: finished(reduce(lambda h, j: h * FACTOR + w[j : j + 1], range(1, len(w)), w[:1]), seed)
        return bool(has_bit(self.buckets.value, self.bucket_bits, h(word))[0] and all(has_bit(self.frequent.value, self.frequent_bits, h(w))[0] for w in (word[:-1], word[1:])))

    def count_buckets(self) -> None:
        if self.into:
            new = np.bincount(np.concatenate(self.into), minlength=len(self.counters))
            self.counters = np.minimum(new + self.counters, 255).astype(np.uint8)
        self.into, self.waiting = [], 0

    def counted(self) -> Iterator[pa.RecordBatch]:
        """Counts of the phrases held: equal hashes are equal phrases unless a look at the words says otherwise."""
        names = list(self.words)
        for lang, parts in self.rows.items():
            ids, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids = ids.reshape(len(h), self.k)
            kinds, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            if not (ids == ids[first[which]]).all():
                _, first, n = np.unique(ids, axis=0, return_index=True, return_counts=True)
                kinds = h[first]
            for at in range(0, len(first), 1 << 16):
                some = slice(at, at + (1 << 16))
                said = [b" ".join([names[i] for i in row]) for row in ids[first[some]].tolist()]
                yield self.batch(lang=[lang] * len(said), phrase=pa.array(said, pa.binary()).cast(pa.string()), n=n[some].astype(np.int64), hash=kinds[some].view(np.int64))
        self.rows, self.held = {}, 0

    def chunks(self) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(self.counters.reshape(-1, min(len(self.counters), 1 << CHUNK_BITS))):
            if part.any():
                yield self.batch(chunk=[k], counters=[pa.compress(part.tobytes(), CODEC, asbytes=True)])

    TYPES = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "hash": pa.int64(), "chunk": pa.int32(), "counters": pa.binary()}
    SCHEMA = "lang string, phrase string, n bigint, hash bigint, chunk int, counters binary"

    @classmethod
    def batch(cls, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in cls.TYPES.items()], list(cls.TYPES))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, up to 255, of the counters of each key of rows sorted by salt and chunk."""
    key = total = None
    for batch in batches:
        for salt, chunk, counters, size in zip(*(batch.column(c).to_pylist() for c in ("salt", "chunk", "counters", "size")), strict=True):
            part = np.frombuffer(pa.decompress(counters, size, CODEC, asbytes=True), np.uint8)
            if (salt, chunk) != key:
                if key:
                    yield _sum(key, total)
                key, total = (salt, chunk), part
            else:
                total = np.minimum(total.astype(np.uint16) + part, 255).astype(np.uint8)
    if key:
        yield _sum(key, total)


def _sum(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pa.compress(total.tobytes(), CODEC, asbytes=True)]), pa.array([len(total)], pa.int32())], ["salt", "chunk", "counters", "size"])


def bucket_bitmap(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets that reach ``least``; it has 2 ** bits bits, and the driver gets no more than as many bytes."""
    size, schema = min(1 << bits, 1 << CHUNK_BITS), "salt int, chunk int, counters binary, size int"
    rows = counted.where("chunk IS NOT NULL").select(F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt"), "chunk", "counters", F.lit(size).alias("size"))
    for salt in (F.col("salt"), F.lit(0)):
        rows = rows.withColumn("salt", salt.cast("int")).repartition("salt", "chunk").sortWithinPartitions("salt", "chunk").mapInArrow(summed, schema)
    out = np.zeros(1 << bits, bool)
    for chunk, counters in rows.select("chunk", "counters").toLocalIterator():
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(pa.decompress(bytes(counters), size, CODEC, asbytes=True), np.uint8) >= least
    return np.packbits(out, bitorder="little").view("<u8").astype(np.uint64)


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = MOST_WORDS, bucket_bits: int = BUCKET_BITS, frequent_bits: int = FREQUENT_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of each phrase of up to ``longest`` words that occurs ``least`` times or more, and (lang, n) with all its words."""
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sent, levels, total, most = spark.sparkContext.broadcast, [], None, min(least, 255)
    frequent = buckets = None
    for k in range(1, longest + 1):
        counted = written(given.mapInArrow(Pass(k, longest, (bucket_bits, frequent_bits), frequent, buckets), Pass.SCHEMA))
        found = counted.where("chunk IS NULL").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        levels.append(written(found.withColumn("words", F.lit(k))))
        if k == 1:
            total = written(counted.where("chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
        if k < longest:
            for old in (frequent, buckets):
                if old:
                    old.unpersist()
            frequent, buckets = sent(hash_bits(levels[-1], "hash", frequent_bits)), sent(bucket_bitmap(counted, most, bucket_bits))
        removed(counted)
    return reduce(DataFrame.unionByName, levels).select("lang", "phrase", "words", "n"), total


def collocations(docs: DataFrame, least: int = LEAST, longest: int = MOST_WORDS, top: int = TOP, **sizes: int) -> DataFrame:
    """The best ``top`` phrases of two words or more of each lang of ``docs`` (text, lang)."""
    found, total = frequencies(docs, least, longest, **sizes)
    total = F.broadcast(total) if total.count() <= 10_000 else total
    candidates = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    longer = candidates.where(F.size("w") > 2).select("lang", F.col("a").alias("within"), F.explode(F.array(*(F.array_join(F.slice("w", F.lit(at), F.size("w") - 1), " ") for at in (1, 2)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    candidates = candidates.join(longer, ["lang", "phrase"], "left").where("within IS NULL OR within < a").drop("within")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    parts = found.select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(total, "lang")
    # decimals of 38 digits hold 1000 * a * n and l * r while both counts are under 10 ** 17
    score = F.expr("CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the best of each salt first, so that a lang's last ranking sees a bounded number of rows
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
