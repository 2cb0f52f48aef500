"""How filters of a corpus interact: who is removed by which filter, in every order of the filters.

A document's failures are a mask of five bits. In an order of the filters it is removed at the first one that it
fails, so a table of 32 masks by 120 orders, made once, holds the step for every case. Narrow rows of part, mask
and labels pass ``mapInArrow``, which looks up a document's 120 steps at once and counts part, order, step and
label with ``np.bincount``; each task hands on one partial array for each part, and Spark sums these. All other
figures follow from the sums of the order at hand and of the orders that begin or end with a filter: whoever fails
a filter is removed at the first step of an order that begins with it, and whoever fails only that one is removed at
the last step of an order that ends with it.

The filters see whole texts: A under 200 words, B under half of the words different, C over 2 in 100 characters
``[A-Z]``, D any of ``[#$%&*|]``, E equal to the text of a smaller doc_id anywhere in the table. Equal texts are
found by their SHA-256, with a minimum of ids (pre-aggregated) that rows meet in a join that skew handling can split.

Edge cases: a null text is an empty one (it fails A; 0 words are not under half); a null source is the part "";
rows with equal ids are documents of their own, and none of them is a copy of the other; a null id is never a copy
and never makes one; an id with several labels is good or toxic if any of its labels says so, a missing label
says neither; long texts are counted in slices; an empty table gives no rows; no other column of the input is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, release, rows_of, sliced, small_batches, table, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
UPPER = bytes(range(65, 91))
#: Bytes that continue a code point.
CONTINUING = bytes(range(0x80, 0xC0))
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Documents looked up at once, and parts whose arrays a task holds before it hands them on.
LOOKED_UP, PARTS = 4096, 256
#: Labels of a document: 1 for good, 2 for toxic.
LABELS = 4


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, at which a document with that mask of failures is removed; 5 if it stays."""
    bits = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> bits) & 1
    return np.where(fails.any(2), fails.argmax(2), STEPS).astype(np.int64)


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, different = 0, set()
    for part in sliced(text):
        words = part.split()
        n += len(words)
        different.update(words)
    upper = len(text) - len(text.translate(None, UPPER))
    points = sum(len(text[at : at + SLICE].translate(None, CONTINUING)) for at in range(0, len(text), SLICE))
    return (n < LEAST_WORDS) | (100 * len(different) < LEAST_DISTINCT * n) << 1 | (100 * upper > MOST_UPPER * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D) and hash of each document's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            masks, hashes = pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "mask": masks, "hash": hashes})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, mask int, hash binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask with E and label of each row."""
    rows = written(rows)
    said = labels.groupBy("doc_id").agg((F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + 2 * F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("label"))
    # only texts that occur under two ids can be copies; dealt out anew, so that the join can split a hot text
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hash", "low").repartition(F.xxhash64("hash", F.lit(1)))
    rows = rows.join(said.where("label > 0"), "doc_id", "left").join(first, "hash", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return rows.select("part", (F.col("mask") + copy).cast("int").alias("mask"), F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def removals(rows: DataFrame) -> DataFrame:
    """part, order, step (0 to 5, where 5 is staying) and how many documents have it: n, good, toxic."""
    found = first_failures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, int] = {}
        counts = np.zeros((0, len(ORDERS), STEPS + 1, LABELS), np.int64)
        orders = np.arange(len(ORDERS)) * (STEPS + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, LOOKED_UP):
                some = batch.slice(at, LOOKED_UP)
                names = some.column("part").dictionary_encode()
                codes = np.array([parts.setdefault(p, len(parts)) for p in names.dictionary.to_pylist()])[names.indices.to_numpy()]
                mask, label = (some.column(n).to_numpy().astype(np.int64) for n in ("mask", "label"))
                if len(parts) > len(counts):
                    counts = np.concatenate((counts, np.zeros((len(parts) - len(counts), *counts.shape[1:]), np.int64)))
                steps = (codes * counts[0].size)[:, None] + (orders + found[mask]) * LABELS + label[:, None]
                counts += np.bincount(steps.ravel(), minlength=counts.size).reshape(counts.shape)
            if len(parts) >= PARTS:
                yield made(parts, counts)
                parts, counts = {}, counts[:0]
        if parts:
            yield made(parts, counts)
        release()

    def made(parts: dict[str, int], counts: np.ndarray) -> pa.RecordBatch:
        cells = len(ORDERS) * (STEPS + 1)
        place = np.tile(np.arange(cells), len(parts))
        named = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), cells)), pa.array(list(parts), pa.string())).cast(pa.string())
        flat = counts.reshape(-1, LABELS)
        return pa.RecordBatch.from_arrays(
            [named, pa.array((place // (STEPS + 1)).astype(np.int32)), pa.array((place % (STEPS + 1)).astype(np.int32)), pa.array(flat.sum(1)), pa.array(flat[:, 1] + flat[:, 3]), pa.array(flat[:, 2] + flat[:, 3])],
            ["part", "order", "step", "n", "good", "toxic"],
        )

    partial = rows.mapInArrow(run, "part string, order int, step int, n bigint, good bigint, toxic bigint")
    return partial.groupBy("part", "order", "step").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part of ``docs`` (doc_id, text, source), order of the filters and step; ``labels`` has doc_id, quality and toxic."""
    sums = removals(labelled(masked(docs), labels))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order") + 1)
    rows = sums.withColumn("filter_order", name).withColumn("filter", F.substring("filter_order", F.col("step") + 1, 1))
    later = Window.partitionBy("part", "order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part", "filter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("n"))).over(own)
    rows = rows.withColumn("kept", F.sum("n").over(later)).withColumns({"fails": at(0), "alone": at(STEPS - 1), "shapley": F.sum("n").over(own)})
    return rows.where(F.col("step") < STEPS).select(
        "part", "filter_order", (F.col("step") + 1).cast("int").alias("step"), "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), F.col("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
