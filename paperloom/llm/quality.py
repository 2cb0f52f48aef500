"""Quality rules with thresholds that each language and source sets for itself.

Counts of a document come from one pass over its whole text. Each count becomes an integer
rate, each rate a bucket of a log-linear histogram (``BITS`` significant bits, so a quantile is
off by under one part in ``2 ** (BITS - 1)``). Histograms are the quantile sketch: they merge by
adding counts, in any order, with the same result, so partial sums run before every shuffle and
a lost task that runs again changes nothing. A group is a language and source. Its fence is the upper
quartile plus ``width`` times the distance of the quartiles, so junk that makes up less than a quarter of a
group does not move it, and no fixed rate is part of it. A group's limit is its fence, drawn towards its
language's by ``prior`` documents, and that likewise towards the fence of all, as logarithms of 1 and more;
both come from the groups' own sketches merged. A document's rate fails if its count lies above what the limit allows by more than
``SIGMAS`` times the root of that and one more: what a short text holds by chance is no evidence.

Edge cases: a null or empty text has no words and fails the base rule; null language or source is a
group of its own; repeated rows and ids are judged row by row; an empty table gives no rows; input
columns that clash with a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plus, rows_of, schema_plus, small_batches, table, written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
BITS = 7
PRIOR = 10
WIDTH = 4
SIGMAS = 3
#: Rate: numerator, factor, denominator.
RATES = {
    "symbols": ("n_symbols", 1000, "n_words"),
    "marks": ("n_marks", 1000, "n_words"),
    "upper": ("n_upper", 1000, "word_chars"),
    "dup_lines": ("n_dup_lines", 1000, "n_lines"),
    "word_len": ("word_chars", 100, "n_words"),
}


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside ``size``-word windows that the text holds twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    base, key = len(known), ids[: n - size + 1].copy()
    if base**size < 2**62:
        for k in range(1, size):
            key = key * base + ids[k : n - size + 1 + k]
    else:
        for k in range(1, size):  # ranks stay below n, so a pair of them always fits
            key = np.unique(key * base + ids[k : n - size + 1 + k], return_inverse=True)[1].astype(np.int64)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(size):
        inside[k : n - size + 1 + k] |= twice
    return int(inside.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    points = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    return (
        len(words), points, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(text) - len(text.translate(None, UPPER)), text.count(b"!"),
    )


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in rows_of(batches):
        cols = zip(*map(counts_of, texts), strict=True)
        yield plus(batch, (), {n: pa.array(c, pa.int64()) for n, c in zip(COUNTS, cols, strict=True)})


def features(docs: DataFrame) -> DataFrame:
    """``docs`` (text, any other columns) with the counts of each whole text."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_counting, schema_plus(docs, (), ", ".join(f"{c} bigint" for c in COUNTS)))


def _rate(name: str) -> Column:
    top, factor, under = RATES[name]
    return F.expr(f"({factor} * {top}) div greatest({under}, 1)")


def excess(name: str) -> str:
    """SQL condition (of Spark and DuckDB alike): the count is over the limit by more than chance."""
    top, factor, under = RATES[name]
    most = f"(limit_{name} * greatest({under}, 1))"
    return f"coalesce({factor} * {top} > {most} AND ({factor} * {top} - {most}) * ({factor} * {top} - {most}) > {SIGMAS**2 * factor} * ({most} + {factor}), false)"


def bucket_of(v: str) -> str:
    return f"CASE WHEN {v} < {2**BITS} THEN {v} ELSE (length(bin({v})) - {BITS}) * {2 ** (BITS - 1)} + shiftright({v}, length(bin({v})) - {BITS}) END"


def value_of(b: str) -> str:
    """Least rate of a bucket."""
    half = 2 ** (BITS - 1)
    return f"CASE WHEN {b} < {2**BITS} THEN {b} ELSE shiftleft({b} - ({b} div {half} - 1) * {half}, cast({b} div {half} - 1 as int)) END"


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def sketch(feats: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: the mergeable histogram of each group, from documents that pass the base rule."""
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), _rate(r).alias("v")) for r in RATES))).alias("r")
    long = feats.where(~base_failed()).select("lang", "source", rates).select("lang", "source", "r.rate", F.expr(bucket_of("r.v")).cast("bigint").alias("bucket"))
    return long.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _fences(hist: DataFrame, keys: list[str], width: int) -> DataFrame:
    """docs and fence (logarithm of it and 1) of each rate for each value of ``keys``; a group has as many rows as buckets, a few thousand at most."""
    by = Window.partitionBy(*keys, "rate")
    cum = hist.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    cum = cum.withColumn("up", F.sum("n").over(by.orderBy("bucket"))).withColumn("docs", F.sum("n").over(by))
    at = lambda k: F.min(F.expr(f"CASE WHEN 4 * up >= {k} * docs THEN {value_of('bucket')} END"))
    q = cum.groupBy(*keys, "rate").agg(F.max("docs").alias("docs"), at(1).alias("low"), at(3).alias("high"))
    return q.select(*keys, "rate", "docs", F.expr(f"ln(1 + high + {width} * (high - low))").alias("fence"))


def thresholds(hist: DataFrame, prior: int = PRIOR, width: int = WIDTH) -> DataFrame:
    """lang, source and ``limit_<rate>``: one row for each group of the sketch."""
    own = _fences(hist, ["lang", "source"], width)
    lang = _fences(hist, ["lang"], width).select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), F.col("docs").alias("l_docs"), F.col("fence").alias("l_fence"))
    every = _fences(hist, [], width).select(F.col("rate").alias("a_rate"), F.col("fence").alias("a_fence"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")), "left").join(every, F.col("rate") == F.col("a_rate"), "left")
    limit = F.expr(f"exp((docs * fence + {prior} * ((l_docs * l_fence + {prior} * a_fence) / (l_docs + {prior}))) / (docs + {prior})) - 1")
    return both.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == r, limit)).alias(f"limit_{r}") for r in RATES))


def judge(feats: DataFrame, limits: DataFrame) -> DataFrame:
    """``feats`` with base_failed and kept. A document whose group has no sketch failed the base rule itself."""
    limits = limits.select(F.col("lang").alias("_limits_lang"), F.col("source").alias("_limits_source"), *(f"limit_{r}" for r in RATES))
    feats = feats.drop(*limits.columns)
    met = feats.join(limits, F.col("lang").eqNullSafe(F.col("_limits_lang")) & F.col("source").eqNullSafe(F.col("_limits_source")), "left").drop("_limits_lang", "_limits_source")
    over = F.expr(" OR ".join(map(excess, RATES)))
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def _without_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _counting(batches):
        yield plus(batch, ("text",), {})


def counts_only(docs: DataFrame) -> DataFrame:
    """``features`` without the text."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_without_text, schema_plus(docs, ("text",), ", ".join(f"{c} bigint" for c in COUNTS)))


def apply(docs: DataFrame, prior: int = PRIOR, width: int = WIDTH) -> DataFrame:
    """``docs`` with counts, limits, base_failed and kept.

    Texts are counted twice, for the sketch and for the verdict, and neither stored nor shuffled in between. Limits are
    a table in the shared folder, so that their join knows their size and broadcasts them only if they are small.
    """
    limits = written(thresholds(sketch(counts_only(docs.select("lang", "source", "text"))), prior, width))
    return judge(features(docs), limits)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = written(counts_only(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")))
    out = judge(feats, thresholds(sketch(feats)))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")
