"""Log-likelihood of whole documents under a gated recurrent language model, and an add-one base.

All training documents are counted, into a table of words. The most frequent ``N_WORDS`` are the model's
own words; every other word, however many there are, belongs to one of ``RARE`` classes of the model by its last
two bytes. These classes are inputs and outputs of the network; inside one, a word has its add-one share of the class's count. The model trains on every training document, in ``ROUNDS`` of
growing shares of them: each task starts from the round's parameters and trains on its documents by
truncated backpropagation, and the next parameters are the tasks' mean, weighted by tokens and taken slot
by slot on the executors. Scoring carries the state through each document; counts of words outside the
``N_SENT`` most frequent come by a join on the word, from a table of words per document that holds only
such words, so it has no hot keys. What goes to the driver or to every executor is bounded: ``N_SENT`` words
and the model's parameters.

Edge cases: null and empty texts are one token, the end; a null id counts as a training document of id ''; texts
of any length are read whole; equal rows share one row of word sums, which is divided among them; rows with
one id and different texts are scored apart; without a training document the base knows no word and the model
is its start; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import rows_of, small_batches, table, written
from .quality import bucket_of, value_of

FOLDS, HELD_OUT = 7, 2
N_WORDS = 1024
N_SENT = 65_536
RARE = 32
#: Shares of the training documents of which each round takes one: a 64th, then an eighth, then the rest.
ROUNDS = ((0, 1), (1, 9), (9, 64))
SLOT = 8192
FLUSH_WORDS = 200_000
BUNCH = 2_000_000
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _share() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(64)), F.lit(64))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for _, texts in rows_of(batches):
        for t in texts:
            counts.update(tokens_of(t))
            if len(counts) > FLUSH_WORDS:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
                counts = Counter()
    if counts:
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def word_counts(train: DataFrame) -> DataFrame:
    """word, n over all of ``train`` (text); the end of a document counts as a word of no bytes."""
    return train.select("text").mapInArrow(_counting, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Ids(dict):
    """Numbers of words; ``other`` for all that are not there."""

    def __init__(self, words=(), other: int = -1):
        super().__init__(words)
        self.other = other

    def __missing__(self, word: bytes) -> int:
        return self.other

    def __reduce__(self):
        return Ids, (list(self.items()), self.other)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(self.other)), np.int32, len(words))


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % RARE


class Endings(dict):
    """Classes of the endings that words had so far, of which there are fewer than 2^17."""

    def __missing__(self, end: bytes) -> int:
        self[end] = rare_class(end)
        return self[end]


ENDINGS = Endings()


class OwnIds(Ids):
    """The model's ids: ``other`` plus its class for a word that is not there."""

    def __missing__(self, word: bytes) -> int:
        return self.other + rare_class(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        unknown = np.flatnonzero(found < 0)
        found[unknown] = [self.other + ENDINGS[words[k][-2:]] for k in unknown.tolist()]
        return found

    def __reduce__(self):
        return OwnIds, (list(self.items()), self.other)


class Lexicon:
    """The most frequent words (``N_SENT`` at most) with their counts, and the totals of all and of each rare class."""

    def __init__(self, top: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], least: int):
        top = sorted(((bytes(w), n) for w, n in top), key=lambda x: (-x[1], x[0]))
        self.own = min(N_WORDS, len(top))
        self.ids = Ids((w, k) for k, (w, _) in enumerate(top))
        self.own_ids = OwnIds(((w, k if k < self.own else self.own + rare_class(w)) for k, (w, _) in enumerate(top)), self.own)
        self.capped = np.array([*self.own_ids.values(), -1], np.int32)  # by id; the last is for none
        self.counts = np.array([n for _, n in top], np.int64)
        self.cuts = gru.cuts_of(self.counts[: self.own])
        self.log = np.log10(self.counts + 1.0)
        self.total, self.distinct, self.least = sum(n for n, _ in classes.values()), sum(v for _, v in classes.values()), least
        self.base_norm = math.log10(self.total + self.distinct + 1)
        #: Counts and words of each rare class, without the model's own.
        rare = np.array([classes.get(k, (0, 0)) for k in range(RARE)], np.int64)
        for w, n in top[: self.own]:
            rare[rare_class(w)] -= (n, 1)
        self.others, self.other_norm = rare[:, 0], np.log10(rare.sum(1) + 1.0)


def lexicon(counts: DataFrame) -> Lexicon:
    """Words of at least ``least`` occurrences, the smallest number (of those that start a bucket) that at most ``N_SENT`` words have.

    The cut comes from a histogram of a few thousand buckets, so neither it nor the words need sorting or more than a bounded collect.
    """
    rare = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(RARE)).cast("int").alias("k")
    classes = {r["k"]: (r["n"], r["words"]) for r in counts.groupBy(rare).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}  # RARE rows at most
    hist = counts.groupBy(F.expr(bucket_of("n")).alias("b")).agg(F.count("*").alias("words")).withColumn("low", F.expr(value_of("b"))).collect()
    least, words = 1 << 62, 0
    for row in sorted(hist, key=lambda r: -r["low"]):
        words += row["words"]
        if words > N_SENT:
            break
        least = row["low"]
    return Lexicon(counts.where(F.col("n") >= least).collect(), classes, least)


def _training(lex, start):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = lex.value.own_ids
        trainer = gru.Trainer(start.value, lex.value.cuts)
        for _, texts in rows_of(batches):
            for t in texts:
                trainer.feed(ids.of(tokens_of(t)))
        trainer.flush()
        if trainer.tokens:
            slots = range(0, len(trainer.flat), SLOT)
            yield pa.RecordBatch.from_pydict({
                "slot": pa.array([a // SLOT for a in slots], pa.int64()), "tokens": pa.array([trainer.tokens] * len(slots), pa.int64()),
                "part": pa.array([trainer.flat[a : a + SLOT].tobytes() for a in slots], pa.binary()),
            })

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of each slot; holds one sum for each slot of the partition."""
    sums: dict[int, list] = {}
    for batch in batches:
        for slot, tokens, part in zip(*(batch.column(c).to_pylist() for c in ("slot", "tokens", "part")), strict=True):
            own = sums.setdefault(slot, [0, 0.0])
            own[0] += tokens
            own[1] = own[1] + np.frombuffer(part, np.float32).astype(np.float64) * tokens
    if sums:
        yield pa.RecordBatch.from_pydict({"slot": pa.array(list(sums), pa.int64()), "part": pa.array([(s / n).astype(np.float32).tobytes() for n, s in sums.values()], pa.binary())})


def train(docs: DataFrame, lex: Lexicon) -> np.ndarray:
    """The model's parameters after all rounds over ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    flat = gru.initial(lex.counts[: lex.own], lex.others)
    sent = sc.broadcast(lex)
    for low, high in ROUNDS:
        part = docs.where((_share() >= low) & (_share() < high)).select("text")
        got = part.mapInArrow(_training(sent, sc.broadcast(flat)), "slot bigint, tokens bigint, part binary").repartition("slot").mapInArrow(_mean, "slot bigint, part binary")
        rows = sorted(got.collect(), key=lambda r: r["slot"])  # the parameters, whose number is fixed
        if rows:
            flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in rows])
    return flat


SCORED = "doc_id bigint, h bigint, held_out boolean, n_tokens bigint, n_known bigint, log_norm double, log_known double, log_other double, log_model double, rare_words array<binary>, rare_tf array<int>"


def _scoring(lex, flat):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexi: Lexicon = lex.value
        own = lexi.own
        keys, ids, own_ids, rare, held = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat_ids, capped, owner = np.concatenate(ids), np.concatenate(own_ids), np.repeat(np.arange(len(ids)), sizes)
            other = capped >= own
            logs = np.where(flat_ids >= 0, lexi.log[flat_ids], 0.0) if len(lexi.log) else np.zeros(len(flat_ids))
            norms = np.where(other, lexi.other_norm[np.maximum(capped - own, 0)], 0.0)
            each = lambda w: np.bincount(owner, w, len(ids))
            logp = gru.score(flat.value, lexi.cuts, own_ids) / math.log(10)
            cols = {n: pa.array(c, t) for n, c, t in zip(("doc_id", "h", "held_out"), zip(*keys, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)}
            return pa.RecordBatch.from_pydict(cols | {
                "n_tokens": pa.array(sizes), "n_known": pa.array(each(flat_ids >= 0).astype(np.int64)), "log_norm": pa.array(each(norms)),
                "log_known": pa.array(each(logs)), "log_other": pa.array(each(logs * other)), "log_model": pa.array(logp),
                "rare_words": pa.array([list(c) for c in rare], pa.list_(pa.binary())), "rare_tf": pa.array([list(c.values()) for c in rare], pa.list_(pa.int32())),
            })

        for batch, texts in rows_of(batches):
            for key, t in zip(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "held_out")), strict=True), texts, strict=True):
                words = tokens_of(t)
                keys.append(key)
                found = lexi.ids.of(words)
                capped = lexi.capped[found]
                unknown = np.flatnonzero(found < 0)
                strange = [words[k] for k in unknown.tolist()]
                capped[unknown] = [own + ENDINGS[w[-2:]] for w in strange]
                rare.append(Counter(strange))
                ids.append(found)
                own_ids.append(capped)
                held += len(words)
                if held >= BUNCH:
                    yield done()
                    keys, ids, own_ids, rare, held = [], [], [], [], 0
        if keys:
            yield done()

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    counts = written(word_counts(docs.where(~F.col("held_out"))))
    lex = lexicon(counts)
    flat = sc.broadcast(train(docs.where(~F.col("held_out")), lex))
    sent = sc.broadcast(lex)
    keyed = docs.withColumn("h", F.xxhash64("text"))
    each = written(keyed.mapInArrow(_scoring(sent, flat), SCORED))
    seldom = counts.where(F.col("n") < lex.least)
    # seldom words are far fewer than their places, so a partition's share of them makes the hash table; nothing is sorted
    places = each.select("doc_id", "h", F.explode(F.arrays_zip("rare_words", "rare_tf")).alias("x")).select("doc_id", "h", F.col("x.rare_words").alias("word"), F.col("x.rare_tf").alias("tf"))
    rare = places.join(seldom.hint("shuffle_hash"), "word")
    sums = rare.groupBy("doc_id", "h").agg(F.sum("tf").alias("rare_n"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_log"))
    copies = each.groupBy("doc_id", "h").agg(F.count("*").alias("copies"))
    sums = sums.withColumnsRenamed({"doc_id": "r_id", "h": "r_h"}).join(copies, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))).select("r_id", "r_h", "rare_n", "rare_log", "copies")
    met = each.join(sums, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")
    rare_n, rare_log = F.coalesce(F.expr("rare_n div copies"), F.lit(0)), F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0))
    return met.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + rare_n).alias("n_known"), F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("log_known") + rare_log - F.col("n_tokens") * F.lit(lex.base_norm)).alias("base_score"),
        (F.col("log_model") + F.col("log_other") + rare_log - F.col("log_norm")).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
