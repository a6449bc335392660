"""Conversations of typed content parts as flat training text, and back.

A visitor walks the parts of a message. Text is escaped, an image, audio or document part
becomes a placeholder; its reference, place and expanded token count are recorded beside the
text. Every message is formatted by itself, so a conversation of any length is spread over
tasks; the text of a conversation is its segments one after another.

The template of a message, with the escaped role and content:

    <|im_start|>role
    content<|im_end|>

Inside roles and content a `<`, any backslashes and a `|` get one more backslash, so no text
can hold a control string, and taking one away again gives the text back. Roles also escape
line breaks and backslashes, as a line break ends them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
MEDIA = ("image", "audio", "document")
PLACEHOLDERS = {kind: f"<|{kind}|>" for kind in MEDIA}
#: Tokens that stand for one unit of a part (an image tile, an audio second, a page), and
#: those that a part has besides.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
TOKENS_BESIDES = 2

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("units", T.LongType()),
    ]
)
PARTS = T.ArrayType(PART)
ATTACHMENT = "struct<kind:string,ref:string,place:long,tokens:long>"
SEGMENT = f"segment string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>, expanded_tokens long"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(r"<\|(im_start|im_end|image|audio|document)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(role)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain, flags=re.DOTALL)


class Flattener:
    """Visits the parts of one message in order and keeps the flat text and its attachments."""

    def __init__(self, offset: int) -> None:
        self.length, self.pieces, self.attachments, self.tokens = offset, [], [], 0

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("kind") or "text"
        if kind == "text":
            self._add(escape((part or {}).get("text") or ""))
        elif kind in PLACEHOLDERS:
            self._attach(kind, part)
        else:
            raise ValueError(f"unknown kind of content part: {kind}")

    def _attach(self, kind: str, part: dict) -> None:
        units = part.get("units")
        tokens = TOKENS_BESIDES + TOKENS_PER_UNIT[kind] * max(1 if units is None else units, 0)
        self.attachments.append(
            {"kind": kind, "ref": part.get("ref"), "place": self.length, "tokens": tokens}
        )
        self.tokens += tokens
        self._add(PLACEHOLDERS[kind])

    def _add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def format_message(role: str | None, parts: list[dict | None] | None) -> dict:
    """One message: its segment, the span under the loss mask, attachments and their tokens."""
    head = f"{START}{escape_role(role or '')}\n"
    visitor = Flattener(len(head))
    for part in parts or []:
        visitor.visit(part)
    learned = role == "assistant"
    return {
        "segment": head + "".join(visitor.pieces) + END,
        "loss_start": len(head) if learned else None,
        "loss_end": visitor.length if learned else None,
        "attachments": visitor.attachments,
        "expanded_tokens": visitor.tokens,
    }


def read_message(segment: str, attachments: list[dict] | None = None) -> tuple[str, list[dict]]:
    """Role and parts of a segment. Adjacent text parts come back as one."""
    if not segment.startswith(START) or not segment.endswith(END):
        raise ValueError("not a formatted message")
    role, _, content = segment[len(START) : -len(END)].partition("\n")
    found, parts, last = iter(attachments or []), [], 0
    for match in _CONTROL.finditer(content):
        if match.start() > last:
            parts.append({"kind": "text", "text": unescape(content[last : match.start()])})
        parts.append({"kind": match[1], "ref": next(found, {}).get("ref")})
        last = match.end()
    if last < len(content):
        parts.append({"kind": "text", "text": unescape(content[last:])})
    return unescape_role(role), parts


def text_parts(text: Column) -> Column:
    """Plain text as the parts of a message; missing text is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text.cast("string"), F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("units"),
        )
    ).cast(PARTS)


def format_conversations(
    df: DataFrame, conversation: str, turn: str, role: str, parts: Column
) -> DataFrame:
    """One formatted segment per message: conversation, turn and the columns of SEGMENT.

    `parts` is an array of PART structs. Missing parts, texts and roles count as empty; a part
    without a kind is text; an unknown kind raises. Missing conversation ids or turns stay
    missing (rows without an id form one conversation; rows without a turn come first). Rows
    that repeat are messages of their own, other columns are ignored, and an empty table gives
    an empty result. Spans and places count code points of the segment.
    """
    rows = df.select(
        F.struct(
            F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{turn}`").alias("turn")
        ).alias("key"),
        F.col(f"`{role}`").cast("string").alias("role"),
        parts.alias("parts"),
    )
    key = rows.schema["key"].dataType.simpleString()
    schema = f"key {key}, {SEGMENT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            done = [
                format_message(role, parts)
                for role, parts in zip(
                    batch.column("role").to_pylist(), batch.column("parts").to_pylist()
                )
            ]
            kinds = kinds or pa.schema(
                [
                    ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                    ("attachments", pa.list_(pa.struct([
                        ("kind", pa.string()), ("ref", pa.string()),
                        ("place", pa.int64()), ("tokens", pa.int64()),
                    ]))),
                    ("expanded_tokens", pa.int64()),
                ]
            )
            made = pa.RecordBatch.from_pylist(done, kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *made.columns], ["key", *made.schema.names]
            )

    made = rows.mapInArrow(run, schema)
    return made.select(
        F.col("key.conversation").alias(conversation), F.col("key.turn").alias(turn),
        "segment", "loss_start", "loss_end", "attachments", "expanded_tokens",
    )


def conversation_digests(segments: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Digests of whole conversations, read back from their segments alone.

    The segments of a conversation stream through one task in order (a SHA-256 has to see them
    one after another), at most an Arrow batch of them in memory. Equal turns are ordered by
    segment. Returns the conversation, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars.
    """
    rows = segments.select(
        F.struct(F.col(conversation).alias("id")).alias("key"),
        F.col(turn).alias("turn"), "segment", "loss_start", "loss_end",
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", "turn", "segment")
    ordered = ordered.drop("turn")
    key = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        current, state = None, None

        def result(states: list) -> pa.RecordBatch:
            columns = [
                [s["turns"] for _, s in states], [s["all"].hexdigest() for _, s in states],
                [s["chars"] for _, s in states], [s["loss"].hexdigest() for _, s in states],
                [s["length"] for _, s in states],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in states], key_type)]
                + [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["key", *names],
            )

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            done = []
            for k, segment, start, end in zip(
                batch.column("key").to_pylist(), batch.column("segment").to_pylist(),
                batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist(),
            ):
                if state is None or k != current:
                    if state is not None:
                        done.append((current, state))
                    current = k
                    state = {"turns": 0, "all": hashlib.sha256(), "chars": 0,
                             "loss": hashlib.sha256(), "length": 0}
                role, parts = read_message(segment)
                text = "".join(
                    p["text"] if p["kind"] == "text" else PLACEHOLDERS[p["kind"]] for p in parts
                )
                state["turns"] += 1
                state["length"] += len(segment)
                state["all"].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start:end])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            if done:
                yield result(done)
        if state is not None:
            yield result([(current, state)])

    made = ordered.mapInArrow(run, schema)
    return made.select(F.col("key.id").alias(conversation), *names)
