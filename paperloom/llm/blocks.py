"""Comparing the members of groups without a row for each pair.

A group's members have labels (what they are joined to already) and are its core, if they are joined to its root, or
its rest. Only pairs of different labels matter. Members are packed into blocks of bounded size, each a row that is
written once, so rows and bytes grow with the members; cells are pairs of numbers of blocks of the rest with each other
and with the core, and meet the two blocks by their numbers. A task holds one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, written

#: What a block holds at most, about; a cell is two blocks. One member may be longer.
BLOCK_MEMBERS, BLOCK_BYTES = 2048, 1 << 22
Member = dict
#: Links of a cell, given the members of one block and those of the other, or None where a block meets itself.
Compare = Callable[[list[Member], list[Member] | None], list[tuple[bytes, bytes]]]


def packed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (grp, block, held) of ``members`` (grp, u, label, rest, payload) where a group has a rest, and how many each group has.

    Blocks of the rest have numbers from 0 on, those of the core from -1 down.
    """
    size, rest = F.octet_length("payload"), F.col("rest")
    total = lambda of, what: F.sum(F.when(of, what).otherwise(F.lit(0)))
    of = lambda n, s: F.greatest(F.ceil(F.col(n) / BLOCK_MEMBERS), F.ceil(F.col(s) / BLOCK_BYTES)).cast("int")
    counts = members.groupBy("grp").agg(total(rest, F.lit(1)).alias("n"), total(rest, size).alias("s"), total(~rest, F.lit(1)).alias("core_n"), total(~rest, size).alias("core_s")).where("n > 0")
    counts = written(counts.select("grp", F.greatest(of("n", "s"), F.lit(1)).alias("rests"), of("core_n", "core_s").alias("cores")))
    dealt = members.join(counts.repartition(F.xxhash64("grp", F.lit(1))), "grp")
    block = F.when(rest, F.pmod(F.xxhash64("u"), F.col("rests"))).otherwise(-1 - F.pmod(F.xxhash64("u"), F.greatest("cores", F.lit(1)))).cast("int")
    return written(dealt.withColumn("block", block).groupBy("grp", "block").agg(F.collect_list(F.struct("grp", "u", "label", "payload")).alias("held"))), counts


def cells(counts: DataFrame) -> DataFrame:
    """grp, one, other: each block of a group's rest with each of its core, and with itself and each later one of the rest."""
    with_core = F.when(F.col("cores") > 0, F.sequence(-F.col("cores"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    others = F.concat(with_core, F.sequence(F.col("one"), F.col("rests") - 1))
    return counts.select("grp", "rests", "cores", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("one")).select("grp", "one", F.explode(others).alias("other"))


def compared(members: DataFrame, compare: Compare) -> DataFrame:
    """u, v: the links that ``compare`` finds in the cells of ``members`` (grp, u, label, rest, payload)."""
    small_batches(members.sparkSession)
    blocks, counts = packed(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(n)[k].as_py() for n in ("a", "b"))
                if links := compare(a, b):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*links, strict=True)], ["u", "v"])
        release()

    side = lambda at, name: blocks.select("grp", F.col("block").alias(at), F.col("held").alias(name))
    met = cells(counts).join(side("one", "a"), ["grp", "one"]).join(side("other", "b"), ["grp", "other"], "left")
    return met.select("a", F.when(F.col("one") != F.col("other"), F.col("b")).alias("b")).mapInArrow(run, "u binary, v binary")


class Joined:
    """Labels joined so far in a task."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: bytes, b: bytes) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
