"""Conversations as one training text with marked turns, checked by a grammar round trip.

Template: each turn is ``<s>ROLE[INST]TEXT[/INST]</s>``. A turn is rendered, read back with the
parser below and compared with its source. Where they differ, the content that conflicts with the
grammar is escaped and the turn rendered again, until both are identical. Escaping puts a backslash
behind the bracket that opens a control string, and one more where there are some already; the
parser takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import tidied

TURN, SAYS, END = "<s>", "[INST]", "[/INST]</s>"
MARK = re.compile("|".join(map(re.escape, (TURN, SAYS, END))))
CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))")

#: A part of the formatted output ends with the turn that reaches so many code points.
PART_CHARS = 1 << 18

PARTS = "conv_id long, part long, text string, loss array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


class Malformed(ValueError):
    """The text isn't a sequence of turns."""


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the text stands, escapes included."""
    turns, want, role, at = [], TURN, "", 0
    for mark in MARK.finditer(text):
        if mark[0] != want:
            raise Malformed(f"{mark[0]} at {mark.start()}, {want} was due")
        between = text[at : mark.start()]
        if want == TURN:
            if between:
                raise Malformed(f"text outside of a turn at {at}")
            want = SAYS
        elif want == SAYS:
            role, want = unescape(between), END
        else:
            turns.append((role, unescape(between), at, mark.start()))
            want = TURN
        at = mark.end()
    if want != TURN or at != len(text):
        raise Malformed("the last turn doesn't end")
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as often as the round trip needs."""
    shown = [role, text]
    while True:
        out = f"{TURN}{shown[0]}{SAYS}{shown[1]}{END}"
        try:
            back = parse(out)
        except Malformed:
            back = []
        if len(back) == 1 and back[0][:2] == (role, text):
            return out
        found = back[0][:2] if len(back) == 1 else ("", "")
        for i, source in enumerate((role, text)):
            if found[i] != source and CONTROL.search(source):
                shown[i] = escape(source)


@tidied
def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, turn, role, text = (batch.column(i) for i in range(4))
        turns = pa.array([render(r or "", t or "") for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([conv, turn, role, turns], ["conv_id", "turn", "role", "rendered"])


@tidied
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered turns in order, put together to parts; only one part is held at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    started, conv, part, chars, held = False, None, 0, 0, []

    def flush():
        text = "".join(held)
        loss = [{"start": a, "end": b} for role, _, a, b in parse(text) if role == "assistant"]
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([text], pa.string()), pa.array([loss], schema.field(3).type)],
            schema=schema)

    for batch in batches:
        for c, rendered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if started and (c != conv or chars >= PART_CHARS):
                yield flush()
                part = part + 1 if c == conv else 0
                chars, held = 0, []
            started, conv = True, c
            held.append(rendered)
            chars += len(rendered)
    if started:
        yield flush()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations (conv_id, turn, role, text)`` to formatted parts, in order within a partition.

    Returns ``conv_id, part, text, loss``: the parts of a conversation, joined in order, are its
    training text; ``loss`` has the code points of a part that count for the loss (what the
    assistant says). Turns are rendered where they lie, then shuffled by conversation and streamed
    in order of ``turn``, so a conversation of any length needs the memory of one part.

    Null text or role: empty. Null ``turn``: before the others; equal turns stand in order of role
    and text, repeated rows stay repeated. A null ``conv_id`` is one more conversation. Empty table:
    no rows. Other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rendered = turns.mapInArrow(_rendered, "conv_id long, turn long, role string, rendered string")
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return ordered.select("conv_id", "rendered").mapInArrow(_joined, PARTS)


@tidied
def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    started, conv = False, None
    turns = loss = None
    n = chars = total = 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]),
             pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([total], pa.int64())], names)

    for batch in batches:
        for row in batch.to_pylist():
            if not started or row["conv_id"] != conv:
                if started:
                    yield flush()
                started, conv, n, chars, total = True, row["conv_id"], 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in parse(row["text"]):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in row["loss"]:
                said = unescape(row["text"][span["start"] : span["end"]])
                loss.update(said.encode())
                chars += len(said)
            total += len(row["text"])
    if started:
        yield flush()


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts in their order."""
    return parts.mapInArrow(
        _digested,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
