"""Chat formatting: typed content parts, flattened by a visitor into one template.

A message is (role, parts); a part is text, image, audio or document. The visitor writes text parts as escaped text, and each other part as its placeholder
in the same place, and records for it: its order in the message, its reference, where it stands in the formatted text, and how many tokens the placeholder expands to (an image: its patches; an audio clip: its
frames; a document: its pages' tokens). A formatted turn is

    <|turn|>ROLE<|body|>CONTENT<|end|>

with a line feed after it. Escaping: in role and text every `<` that runs of backslashes (or none) part from a `|` gets one backslash more before that `|`. So
`<|` stands only where the template put it, any text comes back by taking one backslash away, and texts without `<|` or `<\\|` are unchanged.

The loss mask of an assistant's turn covers its content; spans are [start, end) code points in the formatted turn.

A conversation is a sequence of formatted turns, one row each: (conv_id, seq, formatted, loss spans, attachments); its formatted text is their concatenation in
the order of seq. So a conversation of any length is never held in one row. Digests are read back turn by turn, from rows sorted inside one partition a conversation.

Cases: null role or text is empty; turns come in the order of (turn, role, text), nulls first; equal rows each come out; null parts and parts of unknown types raise no error and count as empty
text; null conv_id is a conversation of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_FORMATTED = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>\n", re.S)
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<part:int,type:string,ref:string,start:int,tokens:long>"
SPAN = "struct<start:int,end:int>"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class Visitor:
    """Flattens parts; one method for each type."""

    def __init__(self, patch: int = 14, frames_a_second: float = 25.0, tokens_a_page: int = 512):
        self.patch, self.frames, self.page = patch, frames_a_second, tokens_a_page

    def content(self, parts: list[dict | None]) -> tuple[str, list[dict]]:
        """Content and attachments; `start` is the placeholder's place in the content."""
        out, attached, size = [], [], 0
        for n, part in enumerate(parts or []):
            part = part or {}
            kind = part.get("type")
            piece, tokens = getattr(self, f"visit_{kind}", self.visit_text)(part)
            if tokens is not None:
                attached.append({"part": n, "type": kind, "ref": part.get("ref"), "start": size, "tokens": tokens})
            out.append(piece)
            size += len(piece)
        return "".join(out), attached

    def visit_text(self, part: dict) -> tuple[str, None]:
        return escape(part.get("text") or ""), None

    def visit_image(self, part: dict) -> tuple[str, int]:
        return "<|image|>", math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)

    def visit_audio(self, part: dict) -> tuple[str, int]:
        return "<|audio|>", math.ceil((part.get("seconds") or 0.0) * self.frames)

    def visit_document(self, part: dict) -> tuple[str, int]:
        return "<|document|>", (part.get("pages") or 0) * self.page


def format_turn(role: str | None, parts: list[dict | None], visitor: Visitor) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """One formatted turn, its loss spans, its attachments with places in the turn."""
    head = TURN + escape(role or "") + BODY
    content, attached = visitor.content(parts)
    for x in attached:
        x["start"] += len(head)
    return head + content + END, [(len(head), len(head) + len(content))] if role == "assistant" else [], attached


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, unescaped; placeholders stay."""
    role, content = _FORMATTED.fullmatch(formatted).groups()
    return unescape(role), unescape(content)


def text_part(text: Column) -> Column:
    """The parts of a message that is text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_messages(messages: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """messages(conv_id, turn, role, parts) to (conv_id, turn, formatted, loss, attachments), a row a turn; no shuffle."""
    visitor = visitor or Visitor()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turn(r, p, visitor) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), pa.array([x[0] for x in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([x[2] for x in done], pa.list_(pa.struct([("part", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("start", pa.int32()), ("tokens", pa.int64())]))),
                ],
                ["conv_id", "turn", "formatted", "loss", "attachments"],
            )

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "parts")
    return rows.mapInArrow(run, f"conv_id long, turn long, formatted string, loss array<{SPAN}>, attachments array<{ATTACHMENT}>")


def numbered(formatted: DataFrame) -> DataFrame:
    """Turns with seq, their place in the conversation from 0."""
    return formatted.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "formatted")) - 1)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; one conversation's hashes are open at a time, so memory doesn't grow with it."""
    out, names = [], [x.split()[0] for x in DIGEST.split(", ")]
    state, last = None, object()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n.endswith("sha256") else pa.int64()) for n, x in zip(names, zip(*out))], names)

    def close() -> None:
        out.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

    for batch in batches:
        for conv, formatted, loss, attached in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "attachments"))):
            if conv != last or state is None:
                if state:
                    close()
                state, last = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], conv
            role, content = parse_turn(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
            state[5] += len(attached)
            state[6] += sum(x["tokens"] for x in attached)
        if len(out) >= 10_000:
            yield rows()
            out.clear()
    if state:
        close()
        yield rows()


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted turns: turns, the hash of role and text of each, and the text under the loss mask."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_digests, DIGEST)
