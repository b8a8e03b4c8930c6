"""Chat formatting (op 5): typed content parts to one string with a loss mask.

A turn's content is a list of typed parts (text, image, audio, document).  A
visitor flattens them in order: text is escaped, every other part becomes a
placeholder ``<|image:K|>`` whose attachment (turn, K, type, reference, expanded
token count) is recorded.  A formatted turn is

    <|im_start|>ROLE NEWLINE CONTENT <|im_end|> NEWLINE

and the content of the trained role is under the loss mask.  Escaping is
reversible and leaves no control opener: a backslash doubles and ``<|`` becomes
``<\\|``, so a text can neither end its turn nor open another; in a role a newline
becomes ``\\n`` too.

Plan: turns are formatted one by one where they lie, without a shuffle.
``read_back`` deals turns by conversation, sorts within partitions and streams
over the formatted strings, keeping only running digests; a conversation of any
length costs constant memory.

Edge cases: a null text has no content; a null role is the empty role; a null
conv_id is a conversation of its own; turns sort by turn (null first), and rows
that repeat a turn by role and text; an empty table gives no row; columns other
than conv_id, turn, role, text (and ``parts``, where given) are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["PartVisitor", "escape", "unescape", "format_turn", "parse_turn", "format_turns", "read_back",
           "PARTS_TYPE"]

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Tokens that a placeholder expands to: per tile, second or page of the part.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,units:int>>"
TURN_SCHEMA = ("conv_id long, turn long, formatted string, mask_start int, mask_end int, "
               "attachments array<struct<position:int,type:string,ref:string,n_tokens:int>>")
CONV_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long, n_attachments long, attachment_tokens long")

_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class PartVisitor:
    """Flattens typed parts in order; one method per part type."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part type: {kind}")
        method(part)

    def visit_text(self, part: dict) -> None:
        body = escape(part.get("text") or "")
        if body and self.out and self.out[-1].endswith("<") and body.startswith("|"):
            body = "\\" + body  # the opener must not form across two text parts either
        if body:
            self.out.append(body)

    def _attach(self, kind: str, part: dict) -> None:
        position = len(self.attachments)
        self.out.append(f"<|{kind}:{position}|>")
        units = max(1, part.get("units") or 1)
        self.attachments.append({"position": position, "type": kind, "ref": part.get("ref"),
                                 "n_tokens": EXPANSION[kind] * units})

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)


def format_turn(role: str | None, parts: list[dict], trained_role: str = TRAINED_ROLE) -> dict:
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    content = "".join(visitor.out)
    head = f"{OPEN}{_escape_role(role or '')}\n"
    trained = role == trained_role
    return {"formatted": f"{head}{content}{CLOSE}\n",
            "mask_start": len(head) if trained else 0, "mask_end": len(head) + len(content) if trained else 0,
            "attachments": visitor.attachments}


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders are not text."""
    if not (formatted.startswith(OPEN) and formatted.endswith(CLOSE + "\n")):
        raise ValueError("not a formatted turn")
    role, _, content = formatted[len(OPEN):-len(CLOSE) - 1].partition("\n")
    return _unescape_role(role), unescape(_PLACEHOLDER.sub("", content))


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("mask_start", pa.int32()),
        ("mask_end", pa.int32()), ("attachments", pa.list_(pa.struct([
            ("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int32())])))])
    for batch in batches:
        rows = [{"conv_id": c, "turn": t, **format_turn(r, p or [])}
                for c, t, r, p in zip(*(batch.column(i).to_pylist() for i in range(4)))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: the formatted string, the span under the loss mask
    (empty for other roles) and the attachments.  Content comes from ``parts``
    (PARTS_TYPE) where the table has it, else from ``text``."""
    if "parts" in turns.columns:
        parts = F.col("parts").cast(PARTS_TYPE)
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"),
                                 F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), parts.alias("parts")
                        ).mapInArrow(_format_batches, TURN_SCHEMA)


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.attached, self.attached_tokens = 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, attached: int, tokens: int) -> None:
        role, text = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(_PLACEHOLDER.sub("", formatted[start:end]))
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())
        self.attached += attached
        self.attached_tokens += tokens

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
                "formatted_chars": self.chars, "n_attachments": self.attached,
                "attachment_tokens": self.attached_tokens}


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])
    now, done = None, []
    for batch in batches:
        for conv, *turn in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Reader(conv)
            now.add(*turn)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if now is not None:
        done.append(now.row())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: turns and loss text
    recovered and digested."""
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    inner = F.substring("formatted", F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN) - len(CLOSE) - 1)
    role = F.substring_index(inner, "\n", 1)
    plain = [F.regexp_replace(c, r"(?s)\\(.)", "$1") for c in (role, F.substring(inner, F.length(role) + 2, F.length("formatted")))]
    return (formatted.withColumns({"by_role": plain[0], "by_text": plain[1]})
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "by_role", "by_text")
            .select("conv_id", "formatted", "mask_start", "mask_end",
                    F.size("attachments").cast("long").alias("n"), tokens.alias("tokens"))
            .mapInArrow(_read_batches, CONV_SCHEMA))
