"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor has one method a type: text is escaped and copied; image, audio and
document parts become ordered placeholders, and each records its attachment reference and the number of
tokens that it will expand to. The template marks every turn as ``<turn:ROLE>`` text ``</turn>`` and a newline;
inside roles and texts a backslash precedes every backslash, ``<`` and ``>``, so no text can hold a control
string and unescaping gives it back exactly. Placeholders are ``<image:0>``, ``<audio:1>``, ``<document:2>``, numbered through
the conversation; a text that says so is escaped, so the two are told apart when they are read back.
Turns travel once to their conversation's partition, sorted, and are formatted as they stream through; a conversation is
never held whole.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, partitions, shared_path

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile(r"<(image|audio|document):(\d+)>")
_TURN = re.compile(rf"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.|{_PLACEHOLDER.pattern.replace('(image', '(?:image').replace('(\\d', '(?:\\d')})*)</turn>\n", re.DOTALL)
_CONTENT = re.compile(rf"((?:[^\\<>]|\\.)+)|{_PLACEHOLDER.pattern}", re.DOTALL)
#: tokens that an attachment expands to: image patches of 28 pixels, audio frames a second, tokens a page
PATCH, FRAMES, PAGE = 28, 25.0, 512


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Visitor:
    """Flattens the parts of one turn; ``first`` is the number of the turn's first placeholder."""

    def __init__(self, first: int = 0):
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.first = first

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown content part {part.get('type')!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * FRAMES))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        mark = f"<{kind}:{number}>"
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "at": sum(map(len, self.pieces)), "tokens": max(1, tokens)})
        self.pieces.append(mark)


def format_turn(role: str | None, parts: list[dict] | None, first: int = 0) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its content in it, attachments); its first placeholder gets the number ``first``."""
    visitor = Visitor(first)
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    head, body = f"<turn:{escape(role or '')}>", "".join(visitor.pieces)
    for a in visitor.attachments:
        a["at"] += len(head)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body), visitor.attachments


def _turns(formatted: str):
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        yield unescape(m[1]), m[2]
        at = m.end()


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; placeholders stay in the text (``parse_parts`` keeps them apart)."""
    return [(role, unescape(body)) for role, body in _turns(formatted)]


def parse_parts(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """(role, [(type, text or placeholder number)]) of every turn; texts that follow each other are one."""
    return [(role, [("text", unescape(m[1])) if m[1] is not None else (m[2], int(m[3])) for m in _CONTENT.finditer(body)]) for role, body in _turns(formatted)]


_ATTACHMENT = "struct<number:int,kind:string,ref:string,at:int,tokens:long>"
_ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
_READ = "struct<type:string,text:string,ref:string,number:int,tokens:long>"


def formatted_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end, attachments for every row, each conversation's in order in one partition; one shuffle.

    Turns are ordered by turn, then role and parts. ``parts`` is an array of typed parts (``PART``). The loss covers the content of
    assistant turns: start and end are code points in the segment, both null elsewhere. Placeholder numbers count within the
    conversation. Null roles and texts are empty; rows may repeat; null conv_ids are one conversation; an empty table gives none.
    Other columns are ignored. An unknown part type raises an error.
    """
    spark = turns.sparkSession
    bounded_batches(spark)

    @lean
    def run(batches):
        now, number = None, 0
        for batch in batches:
            segments, starts, ends, found = [], [], [], []
            for conv, who, what in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "parts")), strict=True):
                if (conv,) != now:
                    now, number = (conv,), 0
                segment, start, end, attachments = format_turn(who, what, number)
                number += len(attachments)
                loss = who == "assistant"
                segments.append(segment)
                starts.append(start if loss else None)
                ends.append(end if loss else None)
                found.append(attachments)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, _ATTACHMENTS)],
                ["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments"],
            )

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.col(parts).alias("parts"))
    texts = F.transform("parts", lambda x: F.coalesce(x["text"], F.lit("")))
    ordered = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", texts, "parts")
    return ordered.mapInArrow(run, f"conv_id long, turn long, segment string, loss_start int, loss_end int, attachments array<{_ATTACHMENT}>")


def write_chats(turns: DataFrame, path: str | None = None, **columns: str) -> str:
    """Write the formatted turns with ``place``, their number in the conversation's partition; return the path.

    Each conversation's turns stand in order in one file. See ``formatted_turns`` for nulls, ties, repeated rows and empty tables.
    """
    rows = formatted_turns(turns, **columns).withColumn("place", F.monotonically_increasing_id())
    path = path or shared_path(turns.sparkSession, "chats")
    rows.write.parquet(path)
    return path


def read_chats(written: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, parts of every written row: texts unescaped, attachments with their reference, number and tokens.

    Null roles and texts come back empty, as they were written; repeated turns are rows like others, an empty table gives no rows.
    """
    parts_type = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("number", pa.int32()), ("tokens", pa.int64())]))

    @lean
    def run(batches):
        for batch in batches:
            roles, parts = [], []
            for segment, attachments in zip(batch.column("segment").to_pylist(), batch.column("attachments").to_pylist(), strict=True):
                ((role, found),) = parse_parts(segment)
                known = {a["number"]: a for a in attachments}
                roles.append(role)
                parts.append([{"type": kind, "text": x} if kind == "text" else {"type": kind, "number": x, "ref": known[x]["ref"], "tokens": known[x]["tokens"]} for kind, x in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "place")), pa.array(roles, pa.string()), pa.array(parts, parts_type)], ["conv_id", "turn", "place", "role", "parts"])

    return written.select("conv_id", "turn", "place", "segment", "attachments").mapInArrow(run, f"conv_id long, turn long, place long, role string, parts array<{_READ}>")


def digests(written: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted segments: counts and SHA-256 of turns and of loss text.

    A null conv_id is one conversation; an empty table gives no rows. One conversation is digested by one task, turn by turn.
    """

    @lean
    def run(batches):
        now, rows = None, []
        for batch in batches:
            for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ((role, text),) = parse(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(segment[start:end])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(segment)
            if len(rows) >= 5000:
                yield batch_of(rows)
                rows = []
        if now is not None:
            rows.append(closed(now))
        if rows:
            yield batch_of(rows)

    def closed(now):
        return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    def batch_of(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    n = partitions(written.sparkSession)
    rows = written.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "place").select("conv_id", "segment", "loss_start", "loss_end")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
