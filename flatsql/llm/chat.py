"""Chat formatting from an event log.

A conversation is a log of events, folded into final messages and rendered by a template. Logs are
partitioned by conversation and sorted by turn and sequence: the events of one message lie together, so a
worker holds one message at a time, however long the conversation. Events:

  open        starts a message in the role it names; a second one in the same turn starts another message
  delta       adds text to the turn's latest message
  edit        replaces that message's text
  regenerate  empties it; later deltas write it anew

An event that finds no open message of its turn starts one in its own role. Other kinds are errors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flatsql.llm.common import batched, rows_of, text_of

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    """Text without '<|', so that no control string can stand in it; unescape() takes it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted message and the range of it that a loss covers, empty unless the role is trained on."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + (len(body) if role in LOSS_ROLES else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a formatted conversation or of a part of one."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no message starts at {at}")
        line, end = formatted.index("\n", at), formatted.index(END, at)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def events_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as events: each row opens a message and writes it in one delta.

    Rows of the same turn are ordered by role, then by the text's SHA-256; nulls first. Repeated rows are
    separate messages. Null roles and texts are empty.
    """
    text = text_of("text")
    plain = rows.select("conv_id", "turn", text_of("role").alias("role"), text.alias("text"), F.sha2(text, 256).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    steps = F.array(F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind"), F.lit("").alias("text")), F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.col("text").alias("text")))
    return plain.select("conv_id", "turn", "role", "tie", "copy", F.explode(steps).alias("e")).select("conv_id", "turn", F.struct("role", "tie", "copy", "e.step").alias("seq"), "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """events(conv_id, turn, seq, kind, role, text) -> (conv_id, turn, role, text): final messages.

    Rows come out in order within a partition, each conversation in one. seq is any type that sorts; events
    that share turn and seq are folded in the order of kind, role and text. A null conv_id is a
    conversation, a null turn the first.
    """
    kind = events.schema["conv_id"].dataType
    turn = events.schema["turn"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("turn", to_arrow_type(turn)), ("role", pa.string()), ("text", pa.string())])

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, role, parts = None, "", []
        for conv_id, turn, kind, new_role, text in rows_of(batches, "conv_id", "turn", "kind", "role", "text"):
            if kind not in ("open", "delta", "edit", "regenerate"):
                raise ValueError(f"unknown kind of event: {kind}")
            if kind == "open" or at != (conv_id, turn):
                if at is not None:
                    yield *at, role, "".join(parts)
                at, role, parts = (conv_id, turn), new_role or "", []
            if kind in ("edit", "regenerate"):
                parts.clear()
            if kind in ("delta", "edit"):
                parts.append(text or "")
        if at is not None:
            yield *at, role, "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(messages(batches), schema, lambda m: 200 + len(m[3]), BATCH_CHARS)

    ordered = events.select("conv_id", "turn", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, turn {turn.simpleString()}, role string, text string")


def format_messages(messages: DataFrame) -> DataFrame:
    """fold()'s rows -> (conv_id, formatted, loss_start, loss_end), in their order: joined, a conversation's parts are its text."""
    kind = messages.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv_id, *render(role, text)) for conv_id, role, text in rows_of(batches, "conv_id", "role", "text"))
        yield from batched(rows, schema, lambda r: 200 + len(r[1]), BATCH_CHARS)

    return messages.mapInArrow(run, f"conv_id {kind.simpleString()}, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """format_messages()'s rows -> one row per conversation, all of it read from the formatted text and its loss ranges:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    kind = formatted.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, n, turns, chars, loss, size = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for conv_id, text, start, end in rows_of(batches, "conv_id", "formatted", "loss_start", "loss_end"):
            if n and at != conv_id:
                yield at, n, turns.hexdigest(), chars, loss.hexdigest(), size
                n, turns, chars, loss, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            at = conv_id
            for role, body in parse(text):
                n += 1
                turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            under = unescape(text[start:end])
            chars += len(under)
            loss.update(under.encode("utf-8", "surrogatepass"))
            size += len(text)
        if n:
            yield at, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(conversations(batches), schema)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
