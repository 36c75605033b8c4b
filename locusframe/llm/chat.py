"""Chat formatting with a grammar round trip.

A turn is written as `<s>assistant\\nTEXT\\n</s>` or `[INST]role\\nTEXT\\n[/INST]`; roles are
percent-encoded. A deterministic parser reads the written turn back. Where role or text differ
from the source, conflicting content is escaped by one backslash before each control string and
the turn is written and read again, until it is identical. The parser takes a control string as
such only without a backslash before it, and takes one backslash off others. Closing strings
follow a newline of the template, so that turns are parsed the same alone and in a row.

Nulls and ties: a null text or role is empty; rows of a null conv_id form one conversation.
Turns with the same number are ordered by role and text; repeated rows are turns of their own.
Other columns are ignored.

Writing and parsing is done turn by turn wherever the rows are. Only digests of a conversation
need its turns in order: they run over sorted partitions and hold one turn at a time.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import prepare, slices

ASSISTANT = "assistant"
OPEN = {True: "<s>", False: "[INST]"}
CLOSE = {True: "</s>", False: "[/INST]"}
_CONTROL = re.compile(r"(\\*)(<s>|</s>|\[INST\]|\[/INST\])")


class NotInGrammar(ValueError):
    """A text that the template cannot have written."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def write(role: str, text: str) -> str:
    """One turn as the template has it; `text` is escaped already where it must be."""
    own = role == ASSISTANT
    return f"{OPEN[own]}{quote(role, safe='')}\n{text}\n{CLOSE[own]}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, at, opened = [], 0, None
    for m in _CONTROL.finditer(formatted):
        if m[1]:
            continue
        mark = m[2]
        if opened is None:
            if m.start() != at or mark not in OPEN.values():
                raise NotInGrammar(f"no turn starts at {at}")
            end = formatted.find("\n", m.end())
            if end < 0:
                raise NotInGrammar("a turn without a role line")
            opened, role, at = mark == OPEN[True], unquote(formatted[m.end() : end]), end + 1
        else:
            if mark != CLOSE[opened] or m.start() <= at or formatted[m.start() - 1] != "\n":
                raise NotInGrammar(f"unexpected {mark} at {m.start()}")
            turns.append((role, unescape(formatted[at : m.start() - 1])))
            opened, at = None, m.end()
    if opened is not None or at != len(formatted):
        raise NotInGrammar("unfinished turn")
    return turns


def round_trip(role: str, text: str) -> tuple[str, str, str, int]:
    """Written turn, role and text as read back, and how often the text was escaped."""
    content, level = text, 0
    while True:
        formatted = write(role, content)
        try:
            read = parse(formatted)
        except NotInGrammar:
            read = []
        if read == [(role, text)]:
            return formatted, *read[0], level
        if level:
            raise NotInGrammar("escaped content must read back")
        content, level = escape(content), level + 1


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, role and text as read back, loss_start and loss_end (in `formatted`), escaped."""

    prepare(turns.sparkSession)

    def render(batches):
        for batch in slices(batches, 2000):
            columns = list(zip(*(round_trip(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))) or [[]] * 4
            formatted, role, text, level = columns
            own = [r == ASSISTANT for r in role]
            start = [f.index("\n") + 1 if o else None for f, o in zip(formatted, own)]
            end = [len(f) - len(CLOSE[True]) - 1 if o else None for f, o in zip(formatted, own)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in (formatted, role, text)),
                 *(pa.array(x, pa.int64()) for x in (start, end)), pa.array(level, pa.int32())],
                ["conv_id", "turn", "formatted", "role", "text", "loss_start", "loss_end", "escaped"],
            )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(
        render, "conv_id long, turn long, formatted string, role string, text string, loss_start long, loss_end long, escaped int"
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for conv, role, text, written, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != at:
                    if state is not None:
                        done.append(close(at, state))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(written[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(written)
            yield batch_of(done)
        yield batch_of([close(at, state)] if state is not None else [])

    def close(conv, state):
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text", "formatted", "loss_start", "loss_end").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
