"""Near-duplicates by min-max hashing.

A document's set holds the 64-bit hashes of its word shingles. Under each of ``HASHES`` permutations (odd multiples
modulo 2 ** 64) both the least and the greatest value are kept: either agrees between two sets with the probability of
their Jaccard similarity, so one evaluation gives two entries of the signature, and their average has a lower variance
than that of as many minima. Bands of ``ROWS`` entries find candidates: at a similarity of 0.8 all bands differ with a
probability of (1 - 0.8 ** 4) ** 28, 4 in 10 million. Links are then confirmed on the full sets.

Documents of equal sets are one class, found by the set's digest before anything is compared. A bucket's classes are
first compared with its least one, in stars that are cut where they are large. What these links join has one label;
buckets that still hold several labels are compared in blocks (see ``blocks``), each pair of classes in the first
bucket that they share only. Sets are made again, by a second look at the texts, for the classes that share a
bucket with another; a bitmap of bounded size keeps most other rows out.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than
a shingle are one shingle; repeated rows and copies have one class; rows with equal ids are documents of their own; a
null id takes part but is never the smallest, unless a component has no other (component_id is null then, and kept is
true); long texts are cut between words and shingles reach over the cut; an empty table gives no rows; no other
column of the input is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Joined, Member, compared
from .common import has_bit, hash_bits, release, rows_of, sliced, small_batches, table, written
from .components import components

SHINGLE, HASHES, ROWS, LEAST = 4, 56, 4, 80
BANDS = 2 * HASHES // ROWS
#: Words whose hashes a task remembers, shingles hashed at once, members of one part of a star, logarithm of the bitmap's bits.
KNOWN, AT_ONCE, STAR, BITMAP_BITS = 1 << 19, 1 << 12, 512, 26
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.Generator(np.random.Philox(12))
MULTIPLES, SHIFTS = _draw.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1), _draw.integers(0, 1 << 64, HASHES, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def shingles(self, text: bytes, k: int = SHINGLE) -> np.ndarray:
        """The set of a text, sorted."""
        carry, found = np.empty(0, np.uint64), []
        for part in sliced(text):
            words = part.lower().split()
            h = np.concatenate((carry, np.fromiter(map(self.__getitem__, words), np.uint64, len(words))))
            if len(h) >= k:
                found.append(np.unique(mixed(reduce(lambda a, j: a * FACTOR + h[j : len(h) - k + 1 + j], range(1, k), h[: len(h) - k + 1]))))
            carry = h[-(k - 1) :]
        if not found and len(carry):
            return mixed(reduce(lambda a, j: a * FACTOR + carry[j : j + 1], range(1, len(carry)), carry[:1] + np.uint64(len(carry))))
        return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else carry


def signature(s: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, in turn."""
    low, high = np.full(HASHES, ~np.uint64(0)), np.zeros(HASHES, np.uint64)
    for at in range(0, len(s), AT_ONCE):
        v = s[at : at + AT_ONCE, None] * MULTIPLES + SHIFTS
        np.minimum(low, v.min(0), out=low)
        np.maximum(high, v.max(0), out=high)
    return np.stack((low, high), 1).ravel()


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the signature, its number included."""
    rows = signature(s).reshape(BANDS, ROWS)
    return mixed(reduce(lambda a, j: a * FACTOR + rows[:, j], range(ROWS), np.arange(BANDS, dtype=np.uint64)))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def pick(key: bytes, doc_id: object) -> int:
    """A number for a class's text in the row of an id."""
    return xxhash.xxh64_intdigest(key + repr(doc_id).encode())


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (the set's digest), pick and bands of each document; the last three are null for an empty set."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch, texts in rows_of(batches):
            sets = [hashes.shingles(t) for t in texts]
            keys = [digest(s) if len(s) else None for s in sets]
            picks = np.array([pick(k, i) if k else 0 for k, i in zip(keys, batch.column("doc_id").to_pylist(), strict=True)], np.uint64).view(np.int64)
            columns = {"n_shingles": pa.array(map(len, sets), pa.int64()), "key": pa.array(keys, pa.binary()), "pick": pa.array(picks), "bands": pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, key binary, pick bigint, bands array<bigint>")


class Picked:
    """Rows (key, text) whose pick the bitmap has, each pick once in a task."""

    def __init__(self, bitmap: Broadcast):
        self.bitmap = bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = Hashes(), set()
        for batch, texts in rows_of(batches):
            keys = [digest(s) if len(s := hashes.shingles(t)) else b"" for t in texts]
            picks = np.array([pick(k, i) for k, i in zip(keys, batch.column("doc_id").to_pylist(), strict=True)], np.uint64)
            at = [k for k in np.flatnonzero(has_bit(self.bitmap.value, BITMAP_BITS, picks)).tolist() if keys[k] and picks[k] not in seen]
            at = list({picks[k]: k for k in at}.values())
            seen.update(picks[at].tolist() if len(seen) < KNOWN else ())
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.binary()), pa.array([texts[k] for k in at], pa.binary())], ["key", "payload"])
        release()


def like(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether sorted sets have a Jaccard similarity of ``least`` in 100."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < least * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members and the head of their part, of rows sorted by head, part and (heads first) kind."""
    hashes, now, own = Hashes(), None, None
    for batch, texts in rows_of(batches, "payload"):
        links = []
        for head, part, kind, key, text in zip(*(batch.column(n).to_pylist() for n in ("head", "part", "kind", "key")), texts, strict=True):
            s = hashes.shingles(text)
            if kind == 0:
                now, own = (head, part), s
            elif (head, part) == now and like(own, s):
                links.append((key, head))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["u", "v"])
    release()


def starred(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: those of ``pairs`` (key, head) whose sets are alike. A head's members are cut into parts of bounded size; each part holds the head once."""
    parts = pairs.groupBy("head").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.join(parts.repartition(F.xxhash64("head", F.lit(1))), "head").select("head", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "key")
    heads = parts.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("head").alias("key"))
    rows = members.unionByName(heads).join(texts, "key")
    return rows.repartition("head", "part").sortWithinPartitions("head", "part", "kind").mapInArrow(stars, "u binary, v binary")


class Compared:
    """Links of a cell: pairs of different labels that share no earlier bucket, whose sets are alike, until all such are joined."""

    def __call__(self, a: list[Member], b: list[Member] | None) -> list[tuple[bytes, bytes]]:
        hashes, joined, links = Hashes(), Joined(), []
        one = self.made(hashes, a)
        other = one if b is None else self.made(hashes, b)
        for k in range(len(a)):
            at = np.flatnonzero(one[2][k] != other[2])
            at = at[at > k] if b is None else at
            at = at[((same := other[1][at] == one[1][k]).any(1)) & (other[1][at, same.argmax(1)] == a[k]["grp"])]
            for j in at.tolist():
                la, lb = a[k]["label"], (b or a)[j]["label"]
                if joined.root(la) != joined.root(lb) and like(one[0][k], other[0][j]):
                    joined.join(la, lb)
                    links.append((a[k]["u"], (b or a)[j]["u"]))
        return links

    @staticmethod
    def made(hashes: Hashes, members: list[Member]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = [hashes.shingles(m["payload"]) for m in members]
        return sets, np.array([bands(s).view(np.int64) for s in sets]), np.array([m["label"] for m in members], object)


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: links between alike classes (key, low.pick, bands), enough of them to join all that any such links join."""
    into = classes.select("key", F.explode("bands").alias("grp"))
    heads = into.groupBy("grp").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1")
    met = written(into.join(heads.repartition(F.xxhash64("grp", F.lit(1))), "grp").select("grp", "key", "head"))
    wanted = classes.select("key", "low.pick").join(met.select("key").distinct(), "key", "left_semi")
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_bits(wanted, "pick", BITMAP_BITS))
    texts = written(docs.select("doc_id", "text").mapInArrow(Picked(bitmap), "key binary, payload binary").withColumn("row", F.monotonically_increasing_id()))
    texts = texts.join(texts.groupBy("key").agg(F.min("row").alias("row")), ["key", "row"], "left_semi").drop("row")  # a repeated row may come from several tasks
    first = written(starred(met.where("key <> head").select("key", "head").distinct(), texts))
    labels = components(first)
    of = lambda at, name: labels.select(F.col("u").alias(at), F.col("root").alias(name)).repartition(F.xxhash64(at, F.lit(1)))
    met = met.where("key <> head").join(of("key", "label"), "key", "left").join(of("head", "core"), "head", "left")
    met = met.select("grp", F.col("key").alias("u"), F.coalesce("label", "key").alias("label"), F.coalesce("core", "head").alias("core")).withColumn("rest", F.col("label") != F.col("core"))
    left = met.groupBy("grp").agg(F.max("rest").alias("any"), F.count("*").alias("n")).where("any AND n > 1").select("grp")
    members = met.join(left.repartition(F.xxhash64("grp", F.lit(1))), "grp", "left_semi").join(texts.withColumnRenamed("key", "u"), "u")
    return first.unionByName(compared(members.select("grp", "u", "label", "rest", "payload"), Compared()))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its component) and kept of each row of ``docs`` (doc_id, text)."""
    rows = written(signed(docs))
    given = rows.where("key IS NOT NULL")
    classes = written(given.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pick")).alias("low"), F.first("bands").alias("bands")))
    found = components(links_of(docs, classes)).select(F.col("u").alias("key"), "root")
    root = written(classes.select("key", "low").join(found, "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")))
    least = root.groupBy("root").agg(F.min("low").alias("low")).repartition(F.xxhash64("root", F.lit(1)))
    named = root.select("key", "root").join(least, "root").select("key", F.col("low.doc_id").alias("component_id"), F.lit(True).alias("linked"))
    out = rows.join(named.repartition(F.xxhash64("key", F.lit(1))), "key", "left").withColumn("component_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
