"""Packing by power-of-two decomposition.

A document's ids, with one end id, are cut into pieces whose lengths are the binary digits of the
count: as many pieces of ``2 ** max_exponent`` as fit, then one for each set bit of the rest, longest
first. Each piece is a sequence of its own, so no sequence crosses documents and none is padded.
Equal lengths form a bucket, from which batches of one shape are drawn; a bucket is a contiguous
range of ``sequence_id``: exponent (4 bits), Spark partition (24 bits), place in it (32 bits). Ids
need no shuffle and no count of other partitions, and are the same when a lost task runs again, as
long as the input is split the same way (a table's files are).

Edge cases: null and empty texts are one piece, the end id; texts of any length are tokenized whole;
repeated rows and ids give their own sequences; an empty table gives no rows; the result has only the
columns named here, whatever others the input has.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, small_batches, table

MAX_EXPONENT = 10
END_ID = 0
#: Fixed value: the string that the vocabulary adds to its merges.
SPECIAL = {"<|endoftext|>": 50256}
#: Fixed value: Unicode's white space, as the pattern of the vocabulary has it.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: Ids that a task holds before it hands on their pieces; one document may have more.
HELD_IDS = 1 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, bucket int, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def vocabulary() -> str:
    """Ranks of the byte-level BPE vocabulary of 50 257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids_of(path: str, text: str) -> list[int]:
    """Ids of the whole text, as the vocabulary's JSON form gives them: its added strings are one id wherever they are.

    White space before a word is one unit but for its last character, which goes with what follows. Long runs are cut
    out as such units here, because the pattern, which looks ahead, would need a stack as deep as they are long.
    """
    own, ids, at = encoder(path), [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += _encoded(own, text[at : run.start()])
        ids += own._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + _encoded(own, text[at:]) if ids else _encoded(own, text)


def _encoded(own, text: str) -> list[int]:
    return own.encode(text, allowed_special="all") if any(s in text for s in SPECIAL) else own.encode_ordinary(text)


def pieces(n: int, max_exponent: int = MAX_EXPONENT) -> list[tuple[int, int]]:
    """(start, exponent) of the pieces of ``n`` ids."""
    full, rest = n >> max_exponent, n & ((1 << max_exponent) - 1)
    out = [(k << max_exponent, max_exponent) for k in range(full)]
    at = full << max_exponent
    for e in range(max_exponent - 1, -1, -1):
        if rest >> e & 1:
            out.append((at, e))
            at += 1 << e
    return out


def pack(docs: DataFrame, path: str | None = None, max_exponent: int = MAX_EXPONENT, end_id: int = END_ID) -> DataFrame:
    """One row for each sequence of ``docs`` (doc_id, text); ``ids`` holds little-endian unsigned 32-bit ids."""
    path = path or vocabulary()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count, rows, held = [0] * (max_exponent + 1), [], 0
        for batch in bounded(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*ids_of(path, text or ""), end_id], "<u4")
                for start, e in pieces(len(ids), max_exponent):
                    rows.append((doc, start, 1 << e, e, len(ids), e << 56 | part << 32 | count[e], 0, ids[start : start + (1 << e)].tobytes()))
                    count[e] += 1
                held += len(ids)
                if held >= HELD_IDS:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
