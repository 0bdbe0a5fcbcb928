"""Chat formatting with a grammar that reads its own output back.

A rendered turn is ``### <Name>: <text> </turn>`` and a line break. The texts of a conversation may
hold anything, so a turn is rendered plainly first, reparsed by the deterministic parser, and only
where the parse differs from the source is its content escaped; the loop ends when the parse gives
the source back. Escaping puts a backslash before backslashes and before the signs that open control
strings, so it can always be undone. The loss mask covers the texts of assistant turns.

Rows of a conversation are ordered by turn (ties by role and text). Null roles and texts are empty; a
null conv_id is one conversation of its own; a role other than system, user and assistant is
written as ``@`` and its escaped name. Repeated rows are turns of their own. Output is one row per
turn, streamed in order, so a conversation of any length needs memory for one turn only. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import batch, saved, tasks, work_dir

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
_SIGN = re.compile(r"[\\#<]")
_ROLE_SIGN = re.compile(r"[\\#<: ]")
_ESCAPE = re.compile(r"\\(.)", re.S)
_END = re.compile(r" </turn>\n")


def escape(text: str, signs: re.Pattern = _SIGN) -> str:
    return signs.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and length of its text inside): plain if that parses back, else escaped."""
    name = NAMES.get(role) or "@" + escape(role, _ROLE_SIGN)
    head = OPEN + name + COLON
    for body in (text, escape(text)):
        turn = head + body + CLOSE
        if parse_turns(turn) == [(role, text, len(head), len(body))]:
            return turn, len(head), len(body)
    raise ValueError("a turn cannot be rendered reversibly")


def parse_turns(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, length of the text in the rendering) of each turn; [] if it isn't the grammar.

    A turn ends at the first control string ``</turn>``; escaped content never holds one, as its
    ``<`` follows a backslash.
    """
    out, at = [], 0
    while at < len(rendered):
        colon = rendered.find(COLON, at)
        end = _END.search(rendered, colon + len(COLON)) if colon >= 0 else None
        if end is None or not rendered.startswith(OPEN, at):
            return []
        start = colon + len(COLON)
        name, body = rendered[at + len(OPEN):colon], rendered[start:end.start()]
        if name in ROLES:
            role = ROLES[name]
        elif name.startswith("@"):
            role = unescape(name[1:])
        else:
            return []
        if OPEN in body:  # a header inside a text would open a turn for a reader that looks for headers
            return []
        out.append((role, unescape(body), start, len(body)))
        at = end.end()
    return out


FORMATTED = "conv_id long, place long, formatted string, loss_start int, loss_length int"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32())])


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation together and in order; sorting spills, so a long one needs no memory."""
    return rows.repartition(tasks(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (0, 1, ... in order), the rendered turn, and the span of it
    under the loss mask (length null: none)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place = object(), 0
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _FORMATTED}
            for conv_id, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if conv_id != conv:
                    conv, place = conv_id, 0
                turn, start, length = render(role, text)
                masked = role == "assistant"
                for k, v in (("conv_id", conv_id), ("place", place), ("formatted", turn), ("loss_start", start if masked else None), ("loss_length", length if masked else None)):
                    out[k].append(v)
                place += 1
            yield batch(out, _FORMATTED)

    return in_order(rows, "turn", "role", "text").mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and give one row per conversation: number of turns, digest of
    its roles and texts, length and digest of the unescaped text under the loss mask, rendered length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def row():
            return batch({"conv_id": [state["id"]], "n_turns": [state["n"]], "turns_sha256": [state["all"].hexdigest()], "loss_chars": [state["chars"]], "loss_sha256": [state["loss"].hexdigest()], "formatted_chars": [state["size"]]}, _DIGEST)

        for b in batches:
            for conv_id, turn, start, length in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not state or conv_id != state["id"]:
                    if state:
                        yield row()
                    state = {"id": conv_id, "n": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                for role, text, _, _ in parse_turns(turn):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if length is not None:
                    text = unescape(turn[start:start + length])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["size"] += len(turn)
        if state:
            yield row()

    return in_order(formatted, "place").mapInArrow(run, DIGEST)


def round_trip(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the formatted conversations and read their digests back."""
    folder = folder or work_dir(conversations.sparkSession, "chat")
    return digests(saved(format_chats(conversations), folder))
