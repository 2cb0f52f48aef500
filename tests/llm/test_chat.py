import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import chat

BITS = ["</s>", "[INST]", "<|im_end|>\n", "<\\|im_start|>", "<\\\\s>", "\\", "a", "é", "\n", "<", "[/INST]", "日", " ", "<<SYS>>"]


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int").repartition(3)


def check(got, rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t, r is not None, r or "", x is not None, x or ""))
    assert {r["conv_id"] for r in got} == set(by) and len(got) == len(by)
    for r in got:
        turns = [(x[3], x[5]) for x in sorted(by[r["conv_id"]], key=lambda x: (x[0], x[1] or 0, x[2], x[3].encode(), x[4], x[5].encode()))]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("batch", [256, 7])
def test_round_trip(spark, monkeypatch, batch):
    """Also when conversations go on in the next batch."""
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\n<s>"]), text(), 1) for c in range(40) for t in range(rng.randrange(1, 30))]
    rows += [(50, 0, None, None, 1), (50, 0, None, None, 1), (51, None, "user", "x", None), (51, 1, "assistant", "", 1), (None, 0, "assistant", "no id", 1), (52, 3, "assistant", "y" * 300_000, 1)]
    monkeypatch.setattr(chat, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    formatted = chat.format_chats(made(spark, rows))
    check(chat.read_back(formatted).collect(), rows)
    parts = formatted.collect()
    assert batch > 7 or any(r["part"] for r in parts)
    for r in parts:
        body = chat.TURN.sub(lambda m: m[1] + m[2], r["formatted"])
        assert not any(c in body for c in chat.CONTROL)
    total = {}
    for r in parts:
        total[r["conv_id"]] = total.get(r["conv_id"], 0) + len(r["formatted"])
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(formatted).collect()} == total


def test_template(spark):
    got = chat.format_chats(made(spark, [(1, 0, "user", "</s> hi", 0), (1, 1, "assistant", "é!", 0)])).first()
    assert got["formatted"] == "<|im_start|>user\n<\\/s> hi<|im_end|>\n<|im_start|>assistant\né!<|im_end|>\n"
    raw = got["formatted"].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in got["loss"]] == ["é!"]


def test_empty_table(spark):
    assert chat.read_back(chat.format_chats(made(spark, []))).count() == 0


def test_long_texts_take_no_indices(monkeypatch):
    """Slices and scattering give the same bytes, and a long text needs a few times its size."""
    rng = random.Random(6)
    conv = np.array([0, 0, 1, 2, 2, 2])
    roles = pa.array(["user", "assistant", "", "user", "x" * 50, "assistant"])
    texts = pa.array(["é" * rng.randrange(0, 60) for _ in range(5)] + [""])
    learned = np.zeros(6, bool)
    scattered = chat.assemble(conv, roles, texts, learned)
    monkeypatch.setattr(chat, "LONG", 20)
    mixed = chat.assemble(conv, roles, texts, learned)
    assert mixed[0] == scattered[0] and all((a == b).all() for a, b in zip(mixed[1:], scattered[1:], strict=True))
    monkeypatch.undo()
    long = pa.array(["y" * 20_000_000])
    tracemalloc.start()
    chat.assemble(np.array([0]), pa.array(["user"]), long, np.zeros(1, bool))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
