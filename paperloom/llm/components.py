"""Connected components of a graph held as a table of edges, by alternating large and small stars.

Each round replaces every edge by edges to the least neighbour: minima come from a partial aggregate,
edges meet them in an equi-join that skew handling can split, so a vertex with any number of edges
needs no task of its own. Rounds are written to the shared folder; the number of rounds grows with the
logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    met = large.join(_apart(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _apart(minima: DataFrame) -> DataFrame:
    """Minima dealt out otherwise than their aggregation left them: the join then shuffles both sides itself, and so can split a hot vertex."""
    return minima.repartition(F.xxhash64("u", F.lit(1)))


def components(edges: DataFrame) -> DataFrame:
    """u, root: each vertex that has an edge to a lesser root of its component; roots have no row.

    ``edges`` has columns u and v of one orderable type; u = v and null are ignored.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = written(_round(now))
        removed(now)
        now, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return now.select("u", F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    n, x, s = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return n, x, s
