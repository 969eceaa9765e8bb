"""Conversations as one text each, with a loss mask, checked by reading them back.

A turn is rendered as ``### role: text </turn>`` and a newline.  The control strings are runs of three or more ``#`` and
``</turn>``; one that follows a backslash is content.  Each rendered turn is parsed by a deterministic parser and compared
with its source; where they differ, a backslash is put before every control string of the text (with the backslashes that it
has), which the parser takes away again, and the result is parsed and compared once more; it is an error if they still differ.  Turns are rendered and read in a stream, sorted within partitions, so a conversation of any
length needs no more memory than its longest turn.

Order within a conversation: turn, then role, then text, nulls first; repeated rows are turns of their own.  A null text or
role is empty; other characters of a role than letters, digits, ``_`` and ``-`` are written ``%XX``.  A null conversation id
is a conversation of its own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import parallelism

CONTROL = re.compile(r"\\*(?:#{3,}|</turn>)")
ESCAPED = re.compile(r"\\(\\*(?:#{3,}|</turn>))")
OPEN = re.compile(r"### ([A-Za-z0-9_%-]*): ")
LIVE = re.compile(r"(?<![\\#])#{3,}|(?<!\\)</turn>")
CLOSE = " </turn>\n"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the text); None for what the grammar does not accept."""
    turns, at = [], 0
    while at < len(rendered):
        head = OPEN.match(rendered, at)
        control = head and LIVE.search(rendered, head.end())
        if not control or control.group() != "</turn>":
            return None
        end = control.start() - 1
        if end < head.end() or rendered[end : end + len(CLOSE)] != CLOSE:
            return None
        turns.append((unquote(head[1]), unescape(rendered[head.end() : end]), head.end(), end))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text begins and ends."""
    head = f"### {quote(role, safe='').replace('.', '%2E').replace('~', '%7E')}: "
    body = text
    while True:
        rendered = head + body + CLOSE
        turns = parse(rendered)
        if turns and len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0][2], turns[0][3]
        if body != text:
            raise ValueError(f"no reversible rendering of a turn of {len(text)} characters")
        body = escape(body)


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, rendered, loss_start, loss_end)`` for every turn, each conversation in order within one partition.

    The conversation's text is its ``rendered`` columns joined; loss spans are within the turn and -1 without loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*render(role, text), role) for role, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            loss = [(a, b) if role == "assistant" else (-1, -1) for _, a, b, role in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                ["conv_id", "rendered", "loss_start", "loss_end"],
            )

    ordered = (
        turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string").alias("_text"))
        .repartition(parallelism(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "_turn", "_role", "_text")
        .select("conv_id", F.coalesce("_role", F.lit("")).alias("_role"), F.coalesce("_text", F.lit("")).alias("_text"))
    )
    return ordered.mapInArrow(run, "conv_id long, rendered string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered turns and its loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        key, state = None, None

        def close() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for conv, rendered, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start >= 0:
                    loss = unescape(rendered[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            yield batch_of(done)
        if state is not None:
            yield batch_of([close()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
