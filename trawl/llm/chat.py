"""Chat formatting with typed content parts.

A visitor walks the parts of a message in order.  Text becomes escaped text; an image, a sound or a
document becomes a numbered placeholder, and what it refers to is recorded with the number of tokens
that the placeholder will be expanded to.  Formatting is done per message, so a conversation of any
length is a run of rows (conv_id, turn) and never one value.

    <turn assistant>escaped text<image 0>more text</turn>\\n

Inside texts and roles a backslash, ``<`` and ``>`` are written as ``\\\\``, ``\\l`` and ``\\g``, so a control
string can't occur in them and the texts can be read back exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ship

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "struct<formatted:string,loss_start:long,loss_end:long,expanded_tokens:long,"
    "attachments:array<struct<ordinal:int,kind:string,ref:string,tokens:long>>>"
)
LEARNED_ROLE = "assistant"
OPEN, CLOSE = re.compile(r"<turn ([^<>]*)>"), "</turn>\n"
PLACEHOLDER = re.compile(r"<(?:image|audio|document) \d+>")
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_ESCAPE, _UNESCAPE = re.compile(r"[\\<>]"), re.compile(r"\\(.)", re.S)
_BACK = {"\\": "\\", "l": "<", "g": ">"}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


@dataclass
class Expansion:
    """Tokens that placeholders stand for: image tiles of ``tile`` pixels, sound frames and document pages."""

    tile: int = 28
    frames_per_second: float = 12.5
    tokens_per_page: int = 256


@dataclass
class Flattener:
    """Visits the parts of one message."""

    expansion: Expansion = field(default_factory=Expansion)
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown content part {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.expansion.tile
        self._attach("image", part, math.ceil((part.get("width") or 1) / side) * math.ceil((part.get("height") or 1) / side))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.expansion.frames_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.expansion.tokens_per_page)
        if part.get("text"):  # its own text follows the placeholder
            self.visit_text(part)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})
        self.pieces.append(f"<{kind} {ordinal}>")


def format_message(role: str, parts: list[dict], expansion: Expansion | None = None) -> dict:
    f = Flattener(expansion or Expansion())
    for part in parts:
        f.visit(part)
    head, body = f"<turn {escape(role)}>", "".join(f.pieces)
    learned = role == LEARNED_ROLE
    return {
        "formatted": head + body + CLOSE, "loss_start": len(head) if learned else None,
        "loss_end": len(head) + len(body) if learned else None,
        "expanded_tokens": sum(a["tokens"] for a in f.attachments), "attachments": f.attachments,
    }


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the messages in a formatted string; placeholders are left out of the text."""
    at = 0
    while at < len(formatted):
        m = OPEN.match(formatted, at)
        end = formatted.find("<", m.end()) if m else -1
        while end >= 0 and not formatted.startswith(CLOSE, end):
            p = PLACEHOLDER.match(formatted, end)
            end = formatted.find("<", p.end()) if p else -1
        if end < 0:
            raise ValueError(f"not a formatted message at {at}")
        yield unescape(m[1]), unescape(PLACEHOLDER.sub("", formatted[m.end() : end]))
        at = end + len(CLOSE)


def text_part(text: Column) -> Column:
    """A list of one text part."""
    blank = {n: F.lit(None) for n in ("ref", "width", "height", "seconds", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            *[v.alias(n) for n, v in blank.items()])).cast(f"array<{PART}>")


def _format(roles: pd.Series, parts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [format_message(r or "", [dict(x) for x in p] if p is not None else []) for r, p in zip(roles, parts, strict=True)],
        columns=["formatted", "loss_start", "loss_end", "expanded_tokens", "attachments"],
    ).astype({"loss_start": "Int64", "loss_end": "Int64"})


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per message: conv_id, turn, formatted, the code points [loss_start, loss_end) under the loss mask
    (null unless the role is ``assistant``), expanded_tokens and attachments.  A conversation's output is its
    rows' ``formatted``, by turn.

    ``parts_col`` names a column of type ``array<PART>``; without it the text is the only part.  Null
    text, parts and roles count as empty; null turns come first; messages of one turn are ordered by
    role and text; an empty table gives an empty table; other columns are not read.
    """
    ship(messages.sparkSession)
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else text_part(F.col(text_col))
    made = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.pandas_udf(_format, FORMATTED).asNondeterministic()(F.col(role_col).cast("string"), parts).alias("f"),
    )
    return made.select("conv_id", "turn", "f.*")


class _Digest:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(formatted)
        for role, text in read_back(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if loss_start is not None:
            learned = unescape(PLACEHOLDER.sub("", formatted[loss_start:loss_end]))
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output of ``format_conversations``, one row per conversation: conv_id, n_turns,
    turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (the text under the
    loss mask) and formatted_chars.  Messages stream by in order; a task holds two hashes, not a conversation."""
    ship(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, *message in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(*message)
            if done:
                yield _rows(done, batch.schema.field(0).type, names)
            last_type = batch.schema.field(0).type
        if now is not None:
            yield _rows([now.row()], last_type, names)

    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _rows(rows: list[tuple], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
