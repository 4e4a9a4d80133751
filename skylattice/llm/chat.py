"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags by segment.

Turns of a conversation stream in order through one task's memory, one turn at a time: rows are dealt
by conversation and sorted by turn, so even a conversation with a third of all rows needs no group in
memory. Every turn becomes a row with its text segments, each flagged whether it counts for the loss.
Control strings of the template inside texts are escaped, so the output can be read back exactly.

Defined results: a null text is empty; a null role is an empty one; a role that the template does not
know keeps its name in a mark of its own and makes the conversation invalid from there; repeated rows are turns of their own, in the order
of (turn, role, text); rows without a conversation id form one conversation without id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.session import ship_package

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn of each role, which roles count for the loss, and which role may follow which.

    ``transitions`` maps a state to the roles allowed in it and the states they lead to; ``finals``
    are the states in which a conversation may end.
    """

    before: dict[str, str]
    after: dict[str, str]
    loss: frozenset[str]
    start: str
    transitions: dict[str, dict[str, str]]
    finals: frozenset[str]
    close_in_loss: bool = False
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if set(self.before) != set(self.after) or not all(self.before.values()):
            raise ValueError("every role needs a mark before its turns, and an entry after")
        marks = [m.strip() for m in [*self.before.values(), *self.after.values()] if m]
        if any(a != b and a.startswith(b) for a in self.before.values() for b in self.before.values()):
            raise ValueError("no mark before a turn may begin another")
        if any(not m or ESCAPE in m or not m[0].isascii() or m[0].isalnum() for m in marks):
            raise ValueError("marks begin with a sign and hold no escape character")

    def signs(self) -> str:
        """The characters that control strings begin with; unescaped, they stand in marks only."""
        own = [*self.before.values(), *self.after.values(), *self.controls, OTHER_ROLE]
        return "".join(sorted({s.strip()[0] for s in own if s.strip()}))


#: How the turn of a role that the template does not know begins and ends; the escaped role stands between sign and close.
OTHER_ROLE, OTHER_CLOSE, OTHER_END = "<<ROLE ", ">> ", "<</ROLE>>"


INSTRUCTION = Template(
    before={"system": "<<SYS>>", "user": "[INST] ", "assistant": "<<ANS>> "},
    after={"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"},
    loss=frozenset({"assistant"}),
    start="start",
    transitions={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    finals=frozenset({"asked", "answered"}),
    controls=("<s>", "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "<<ANS>>"),
)


def escaper(template: Template):
    """A function that puts the escape character before itself and every sign that a control string begins with."""
    pattern = re.compile("[" + re.escape(template.signs() + ">" + ESCAPE) + "]")
    return lambda text: pattern.sub(lambda m: ESCAPE + m[0], text)


_UNESCAPE = re.compile(re.escape(ESCAPE) + "(.)", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """One row per turn, conversations contiguous and in order in each partition.

    conv_id, number (of the turn in its conversation, from 0), role, state (after the turn; "invalid"
    for good after a turn that the machine does not allow), segments (array of text and loss).
    """
    ship_package(turns.sparkSession)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("number", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("state", T.StringType()),
                           T.StructField("segments", T.ArrayType(SEGMENT))])
    arrow_segments = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = escaper(template)
        conversation, number, state, begun = None, 0, template.start, False
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or key != conversation:
                    conversation, number, state, begun = key, 0, template.start, True
                state = template.transitions.get(state, {}).get(role, "invalid")
                before = template.before.get(role) or OTHER_ROLE + escape(role) + OTHER_CLOSE
                counts = role in template.loss
                parts = [(before, False), (escape(text), counts), (template.after.get(role, OTHER_END), counts and template.close_in_loss)]
                for column, value in zip(out, (key, number, role, state, [{"text": t, "loss": m} for t, m in parts if t]), strict=True):
                    column.append(value)
                number += 1
                held += len(text)
                if held > 4 << 20:
                    yield _batch(out, schema.names, arrow_segments)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield _batch(out, schema.names, arrow_segments)

    return _ordered(turns).mapInArrow(kernel, schema)


def _batch(out: list[list], names: list[str], segments: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), segments)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


class Reader:
    """Reads formatted text back: whole conversations or single turns."""

    def __init__(self, template: Template = INSTRUCTION):
        self._roles = {mark: role for role, mark in template.before.items()}
        self._after = template.after
        other = re.escape(OTHER_ROLE) + r"(?P<role>(?:\\.|[^\\>])*)" + re.escape(OTHER_CLOSE)
        self._begin = re.compile("(?s:" + "|".join([*map(re.escape, self._roles), other]) + ")")
        plain = "[^" + re.escape(template.signs() + ESCAPE) + "]"
        self._text = re.compile(rf"(?s:(?:\\.|{plain})*)")

    def conversation(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of every turn, unescaped."""
        turns, at = [], 0
        while at < len(text):
            mark = self._begin.match(text, at)
            if not mark:
                raise ValueError(f"no turn begins at {text[at : at + 40]!r}")
            role = self._roles.get(mark[0])
            after = self._after[role] if role is not None else OTHER_END
            role = unescape(mark["role"]) if role is None else role
            # The text runs to the first unescaped sign, less what the closing mark has before its own sign.
            lead = len(after) - len(after.lstrip())
            end = self._text.match(text, mark.end()).end() - (lead if after else 0)
            if text[end : end + len(after)] != after:
                raise ValueError(f"turn of {role!r} does not end with its mark")
            turns.append((role, unescape(text[mark.end() : end])))
            at = end + len(after)
        return turns


def digests(turns: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Per conversation, read back from the rows of :func:`formatted` as they stream: hashes and counts.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.
    """
    schema = T._parse_datatype_string(
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        reader = Reader(template)
        key, total, done = None, None, []

        def close() -> None:
            turns_hash, loss_hash = total["turns"].hexdigest(), total["loss"].hexdigest()
            done.append((key, total["n"], turns_hash, total["loss_chars"], loss_hash, total["chars"], total["state"] in template.finals))

        for batch in batches:
            for conv, state, number, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "state", "number", "segments")), strict=True):
                if number == 0:
                    if total is not None:
                        close()
                    key, total = conv, {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "state": ""}
                whole = "".join(s["text"] for s in segments)
                ((role, text),) = reader.conversation(whole)
                total["turns"].update(f"{role}\n{text}\n".encode())
                counted = unescape("".join(s["text"] for s in segments if s["loss"]))
                total["loss"].update(counted.encode())
                total["n"] += 1
                total["loss_chars"] += len(counted)
                total["chars"] += len(whole)
                total["state"] = state
            if done:
                yield _rows(done, schema.names)
                done = []
        if total is not None:
            close()
        if done:
            yield _rows(done, schema.names)

    return formatted(turns, template).mapInArrow(kernel, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
