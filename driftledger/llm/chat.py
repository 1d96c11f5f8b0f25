"""Chat formatting of typed content parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END, STOP = "<|turn|>", "<|end|>\n", "\n"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "conv_id long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<number:int,turn:long,type:string,ref:string,start:long,n_tokens:long>>, n_tokens long"
)


def escape(text: str | None) -> str:
    """No control string can begin in the result: they all hold a bar, and each bar of the text has a backslash before it."""
    return (text or "").replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Flattener:
    """Visits the content parts of a conversation in order: texts are escaped, all others become numbered placeholders."""

    def __init__(self, patch: int = 14, tokens_per_second: float = 25.0, tokens_per_page: int = 512):
        self.patch, self.tokens_per_second, self.tokens_per_page = patch, tokens_per_second, tokens_per_page
        self.attachments: list[dict] = []

    def visit(self, part: dict, turn: int | None, at: int) -> str:
        kind = part.get("type") or "text"
        count = getattr(self, f"count_{kind}", None)
        if kind == "text" or count is None:  # an unknown kind has nothing but its text
            return escape(part.get("text"))
        number = len(self.attachments)
        self.attachments.append({"number": number, "turn": turn, "type": kind, "ref": part.get("ref"), "start": at, "n_tokens": count(part)})
        return f"<|{kind}:{number}|>"

    def count_image(self, part: dict) -> int:
        return ceil((part.get("width") or 0) / self.patch) * ceil((part.get("height") or 0) / self.patch)

    def count_audio(self, part: dict) -> int:
        return ceil((part.get("seconds") or 0.0) * self.tokens_per_second)

    def count_document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.tokens_per_page


def format_turns(turns: Iterator[tuple[int | None, str | None, list[dict] | None]]) -> dict:
    """One conversation: ``<|turn|>role``, a line break, the parts, ``<|end|>`` and a line break for each turn."""
    visitor, pieces, loss, at = Flattener(), [], [], 0
    for turn, role, parts in turns:
        head = TURN + escape(role).replace("\n", "\\n") + STOP
        at += len(head)
        pieces.append(head)
        for part in parts or []:
            placed = len(visitor.attachments)
            piece = visitor.visit(part, turn, at)
            pieces.append(piece)
            if role == "assistant" and len(visitor.attachments) == placed:
                loss.append({"start": at, "end": at + len(piece)})
            at += len(piece)
        pieces.append(END)
        at += len(END)
    return {"formatted": "".join(pieces), "loss": loss, "attachments": visitor.attachments, "n_tokens": sum(a["n_tokens"] for a in visitor.attachments)}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, body) of each turn, unescaped; placeholders stay as they are written."""
    turns = []
    for block in formatted.split(END)[:-1]:
        role, _, body = block.removeprefix(TURN).partition(STOP)
        turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL), unescape(body)))
    return turns


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments, n_tokens), one row for each conversation.

    ``messages`` has conv_id, turn, role and content, an array of parts (see PART). Turns are ordered by turn, nulls first,
    ties by role and content, so repeated rows are repeated turns. A null role is empty, null content has no parts, a null
    text is empty; rows without conv_id are one conversation. Loss spans are the text parts of the role ``assistant``, in code
    points of ``formatted``; placeholders are in none. n_tokens is what the placeholders expand to; an attachment without a size expands to none.
    Conversations are dealt by conv_id and read in order, so a task holds one conversation at a time: that is one training
    example, and no larger than a row may be. An empty table gives no rows; other columns are not looked at.
    """
    ordered = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("content").cast(f"array<{PART}>"))
    ordered = ordered.withColumn("tie", F.to_json("content")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").drop("tie")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "content")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, own, turns = [], 0, None, []
        for conv_id, turn, role, content in rows(batches):
            if turns and conv_id != own:
                done.append({"conv_id": own, **format_turns(iter(turns))})
                size, turns = size + len(done[-1]["formatted"]), []
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(done, _SCHEMA)
                done, size = [], 0
            own = conv_id
            turns.append((turn, role, content))
        if turns:
            done.append({"conv_id": own, **format_turns(iter(turns))})
        yield pa.RecordBatch.from_pylist(done, _SCHEMA)

    return ordered.mapInArrow(run, FORMATTED)


_SCHEMA = pa.schema([
    ("conv_id", pa.int64()),
    ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("turn", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64())]))),
    ("n_tokens", pa.int64()),
])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for conv_id, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = parse(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                found.append((conv_id, len(turns), sha(told), len(under), sha(under), len(text)))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def text_part(text: str) -> Column:
    """The content of a plain message: one text part."""
    empty = [F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), *empty))
