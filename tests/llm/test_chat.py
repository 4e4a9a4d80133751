from __future__ import annotations

import hashlib
import random

import pytest

from skylattice.llm import chat


def brute(turns):
    whole = {}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv, turn, role, text in turns:
        whole.setdefault(conv, []).append((conv, turn, role, text))
    for conv, rows in whole.items():
        rows.sort(key=order)
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        yield (conv, len(rows), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def corpus(seed):
    pick = random.Random(seed)
    parts = ["<", "<<", ">>", "[", "[INST]", " [/INST]", "</s>", "<<SYS>>", "<</SYS>>", "<<ANS>> ", "\\", "\\\\", "<<ROLE ", "<</ROLE>>", "é", "a\n", " "]
    text = lambda: "".join(pick.choice(parts) for _ in range(pick.randrange(0, 9)))
    turns = []
    for conv in range(60):
        for turn in range(pick.randrange(1, 7)):
            role = pick.choice(["user", "assistant"]) if pick.random() < 0.8 else pick.choice(["system", "tool>> x\\", "", None, "User"])
            turns.append((conv, turn, role, pick.choice([None, text(), text(), text()])))
    turns += [(200, None, "user", "x"), (None, 0, "user", "no id"), (None, 1, "assistant", "b"), turns[3], (201, 0, "assistant", "long " * 300_000)]
    return turns


@pytest.mark.parametrize("seed", [1, 2])
def test_read_back_equals_the_input(spark, seed):
    turns = corpus(seed)
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, state string").repartition(3)
    got = [tuple(r)[:5] for r in chat.digests(df).collect()]
    assert sorted(got, key=str) == sorted(brute(turns), key=str)


def test_whole_conversations_read_back(spark):
    turns = [t for t in corpus(5) if t[0] is not None and t[0] < 60]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1)
    rows = chat.formatted(df).collect()
    reader = chat.Reader()
    for conv in {t[0] for t in turns}:
        whole = "".join(s.text for r in rows if r.conv_id == conv for s in r.segments)
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert reader.conversation(whole) == [(r, t) for _, r, t in own]


def test_states_and_loss(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "system", "s")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = sorted(chat.formatted(df).collect(), key=lambda r: (r.conv_id, r.number))
    assert [r.state for r in rows] == ["briefed", "asked", "answered", "invalid", "invalid", "briefed"]
    assert [(s.text, s.loss) for s in rows[2].segments] == [("<<ANS>> ", False), ("a", True), ("</s>", False)]
    assert {r.conv_id: r.valid for r in chat.digests(df).collect()} == {1: True, 2: False, 3: False}


def test_empty_table_and_bad_templates(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    other = {"start": "start", "transitions": {}, "finals": frozenset(), "loss": frozenset()}
    for before, after in (({"a": "<a>"}, {}), ({"a": "<a", "b": "<ab"}, {"a": "", "b": ""}), ({"a": "a:"}, {"a": ""})):
        with pytest.raises(ValueError, match="mark"):
            chat.Template(before=before, after=after, **other)
    with pytest.raises(ValueError, match="no turn"):
        chat.Reader().conversation("hello")


def test_query_adds_the_control_conversation(spark, tmp_path):
    from skylattice.llm.queries import CONTROL_TEXT, op4_chat

    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r)[:5] for r in op4_chat(spark, str(tmp_path)).collect())
    assert got == sorted(brute([(1, 0, "user", "hi"), (-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]))
