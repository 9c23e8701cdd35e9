"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " Role ": " text " </turn>" LF
    Role         := "System" | "User" | "Assistant" | "Tool" | "Role(" text ")"
    text         := (any character but a backslash, where no control string begins | backslash any character)*

Control strings are "### " and "</turn>". The parser is deterministic: after a turn's end there is a header or the end, and a text
ends at the first " </turn>" with a line end; it undoes the escapes and refuses texts that hold a bare control string. A
conversation is rendered as it is and reparsed. The texts of turns that don't come back are then escaped (a backslash before
each control string and each backslash), and so on until the recovered turns are the source. In a role without a name
every character that can take part in a header is escaped from the start.

The loss mask is over the assistants' texts in the rendered form: spans of characters from the first to past the last.

Edge cases: null texts are empty; a null role is the empty other role; rows of one turn number are ordered by role and text;
repeated rows are turns each; rows without a conversation id form one conversation. Conversations are streamed from sorted
partitions, so a task holds one conversation at a time, however long. An empty table gives no rows. Extra columns are dropped, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
#: The roles that have names in the template.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}

_CONTROL = re.compile(r"\\|### |</turn>")
_HEADER_CHARS = re.compile(r"[\\#<):]")
_PIECE = re.compile(r"\\.|### |</turn>", re.DOTALL)
_HEADER = re.compile(r"### (?:(System|User|Assistant|Tool)|Role\(((?:[^\\)]|\\.)*)\)): ", re.DOTALL)


def escape(text: str, chars: re.Pattern = _CONTROL) -> str:
    """A backslash before whatever matches."""
    return chars.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(turns: list[tuple[str, str]], escaped: Container[int] = ()) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistants' texts in it; escaped: turns whose texts are escaped."""
    parts, at, spans = [], 0, []
    for k, (role, text) in enumerate(turns):
        name = NAMES.get(role) or f"Role({escape(role, _HEADER_CHARS)})"
        head, body = f"{OPEN}{name}: ", escape(text) if k in escaped else text
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted conversation, one by one; ValueError where it stops being one."""
    at = 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        end = formatted.find(CLOSE, head.end())
        if end < 0:
            raise ValueError(f"no end of the turn at {at}")
        body = formatted[head.end() : end]
        if any(m[0][0] != "\\" for m in _PIECE.finditer(body)):
            raise ValueError(f"a control string in the turn at {at}")
        yield ROLES[head[1]] if head[1] else unescape(head[2]), unescape(body)
        at = end + len(CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    return list(turns_of(formatted))


def comes_back(turns: list[tuple[str, str]], formatted: str) -> bool:
    try:
        return parse(formatted) == turns
    except ValueError:
        return False


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The first rendering that reparses to the source: more texts are escaped until one does."""
    escaped: set[int] = set()
    while True:
        text, spans = render(turns, escaped)
        if comes_back(turns, text):
            return text, spans
        conflicting = {k for k, turn in enumerate(turns) if not comes_back([turn], render([turn], (0,) if k in escaped else ())[0])}
        if conflicting <= escaped:
            raise ValueError("the conversation can't be formatted")
        escaped |= conflicting


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """id_col, formatted and spans (array of struct(start, end), in characters) for each conversation of rows (role, text)."""
    kind = dict(rows.dtypes)[id_col]
    source = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        turns: list[tuple[str, str]] = []
        done: list[tuple] = []
        current: list = []

        def close() -> None:
            text, spans = formatted(turns)
            done.append((current[0], text, [{"start": a, "end": b} for a, b in spans]))
            turns.clear()

        def flush(schema: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ((), (), ())
            out = [pa.array(c, k) for c, k in zip(columns, (schema, pa.string(), spans_kind), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=["id", "formatted", "spans"])

        schema = None
        for batch in batches:
            schema = batch.schema.field("id").type
            for key, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if turns and current[0] != key:
                    close()
                current[:] = [key]
                turns.append((role, text))
            yield flush(schema)
        if turns:
            close()
            yield flush(schema)

    ordered = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"id {kind}, formatted string, spans array<struct<start: bigint, end: bigint>>").withColumnRenamed("id", id_col)


def read_back(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col, turns (array of struct(role, text)) and loss (the unescaped text under the mask) of formatted conversations."""
    kind = dict(conversations.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, loss = [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("formatted"), pa.array(turns, turn), pa.array(loss, pa.string())], names=["id", "formatted", "turns", "loss"])

    rows = conversations.select(F.col(id_col).alias("id"), "formatted", "spans")
    return rows.mapInArrow(run, f"id {kind}, formatted string, turns array<struct<role: string, text: string>>, loss string").withColumnRenamed("id", id_col)
