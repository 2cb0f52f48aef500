"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts get a backslash behind their
first character, and ones that have backslashes there get one more, so the text comes back exactly. Turns
of a conversation meet in order by one shuffle on its id. For each Arrow batch, numpy works out every
segment's length, the running sums of these as offsets, and from them the indices at which headers and
contents are scattered into one preallocated buffer, which becomes the Arrow column as it is; contents of ``LONG``
bytes or more are copied as slices, since indices take eight bytes a byte. A conversation
that goes on in the next batch goes on in the next part (row) of the result, so memory does not depend on
its length.

Edge cases: null text is empty, null role is an empty role; turns of equal number are in order of role and
text, null turns first; null ids are one conversation; a role may hold any characters; repeated rows are
turns of their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LONG = 1 << 12
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
_UNESCAPE, TURN = re.compile(UNESCAPE), re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=ESCAPE, replacement=r"\1\\\2\3")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def role_written(roles: pa.Array) -> pa.Array:
    for old, new in (("\\", "\\\\"), ("\n", "\\n")):
        roles = pc.replace_substring(roles, pattern=old, replacement=new)
    return escaped(roles)


def role_read(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the length of each text."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, learned: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted text of each run of equal ``conv``, first row of each run, and start and end (bytes, in the run's text) of each turn's text."""
    n = len(conv)
    roles, role_n = _bytes(role)
    texts, text_n = _bytes(text)
    lengths = np.stack([np.full(n, len(START)), role_n, np.full(n, len(MIDDLE)), text_n, np.full(n, len(END))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for k, constant in ((0, START), (2, MIDDLE), (4, END)):
        out[begins[:, k, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for k, source, count in ((1, roles, role_n), (3, texts, text_n)):
        at, long = np.cumsum(count) - count, count >= LONG
        for r in np.flatnonzero(long).tolist():
            out[begins[r, k] : ends[r, k]] = source[at[r] : at[r] + count[r]]
        short = np.where(long, 0, count)
        place = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
        out[np.repeat(begins[:, k], short) + place] = source[np.repeat(at, short) + place]
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    starts = begins[first, 0]
    offsets = np.r_[starts, ends[-1, -1]].astype(np.int64)
    base = np.repeat(starts, np.diff(np.r_[first, n]))
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
    return column.cast(pa.string()), first, begins[:, 3] - base, ends[:, 3] - base


def _formatting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        conv = pc.fill_null(pc.dictionary_encode(ids).indices, -1).to_numpy(zero_copy_only=False)
        role = pc.fill_null(batch.column("role"), "")
        learned = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
        column, first, begin, end = assemble(conv, role_written(role), escaped(pc.fill_null(batch.column("text"), "")), learned)
        bounds, keys, parts = np.r_[first, len(conv)].tolist(), ids.take(pa.array(first)).to_pylist(), []
        for key in keys:
            part = part + 1 if key == last else 0
            last = key
            parts.append(part)
        loss = [[{"start": int(begin[k]), "end": int(end[k])} for k in range(a, b) if learned[k]] for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({
            "conv_id": pa.array(keys, pa.int64()), "part": pa.array(parts, pa.int64()), "n_turns": pa.array(np.diff(bounds), pa.int64()),
            "formatted": column, "loss": pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted and loss: the bytes (UTF-8) of ``formatted`` that are learned, the assistant's texts.

    The parts of a conversation, in order, are its formatted text; they are rows of one partition, in order.
    """
    small_batches(turns.sparkSession)
    near = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return near.mapInArrow(_formatting, PARTS)


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns, unescaped, from formatted text alone; the learned text from the mask alone."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, rows = None, []

    def close() -> None:
        if now:
            key, n, turns, chars, loss, size = now
            rows.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for key, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
            if part == 0:
                close()
                now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            for m in TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {key}: {text[at:m.start()]!r} is no turn")
                at = m.end()
                now[1] += 1
                now[2].update(f"{role_read(m[1])}\n{unescaped(m[2])}\n".encode())
            if at != len(text):
                raise ValueError(f"conversation {key}: {text[at:]!r} is no turn")
            raw = text.encode()
            for s in loss:
                learned = unescaped(raw[s["start"] : s["end"]].decode())
                now[3] += len(learned)
                now[4].update(learned.encode())
            now[5] += len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of ``format_chats``' result: digests of what its text and mask hold."""
    return formatted.mapInArrow(_reading, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return read_back(format_chats(turns.unionByName(extra)))
