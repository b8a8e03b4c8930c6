"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a whole Arrow batch at once (one flat
byte array plus document offsets), so the Python side costs a few array passes
per batch instead of a loop over documents.  Batches are cut into slices of a
few MB of text, so memory does not follow the size of a partition.

Fingerprints are polynomial hashes modulo 2**64 over randomised byte codes;
equal byte strings always agree, different ones collide with probability
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["mix64", "ByteHasher", "TextSlice", "text_slices", "pad_documents", "word_windows", "segment_sums"]

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: spreads entropy over all bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * _U(BASE) + _U(seed))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SEPARATOR = _table(b" \t\n\x0b\x0c\r")
SYMBOL = _table(b"#*$%&|<>")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODEPOINT_START = (np.arange(256) & 0xC0) != 0x80


class ByteHasher:
    """Prefix sums of code[b_i] * BASE**i; any range hash is then two lookups."""

    _pow: np.ndarray = np.ones(1, dtype=np.uint64)
    _inv: np.ndarray = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        self._grow(n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_codes(seed)[data] * ByteHasher._pow[:n], out=self.prefix[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, BASE, dtype=np.uint64)
            step[0] = 1
            cls._pow = np.cumprod(step)
            step[1:] = _U(pow(BASE, -1, 1 << 64))
            cls._inv = np.cumprod(step)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], comparable across slices; the length is
        mixed in, so ranges of different lengths differ."""
        raw = (self.prefix[end] - self.prefix[start]) * ByteHasher._inv[start]
        return mix64(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of every width-byte window of the flat array."""
        n = len(self.prefix) - 1
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self.prefix[width:] - self.prefix[:-width]) * ByteHasher._inv[:n - width + 1])


class TextSlice:
    """Flat bytes and offsets of some rows of an Arrow batch (null text: empty)."""

    def __init__(self, column: pa.Array):
        if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
            column = column.cast(pa.string())
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, offs, data = column.buffers()
        n = len(column)
        if n == 0:
            self.offsets, self.data = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
            return
        o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
        flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = flat[o[0]:o[-1]]
        self.offsets = (o - o[0]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of true flags (one per byte) in each document."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def words(self, lower: bool = False, seed: int = 1) -> "Words":
        return Words(self, lower, seed)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every line: documents cut at newlines."""
        nl = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.offsets[:-1], nl + 1]), kind="stable")
        # a newline ends its line; the last line of a document ends with it
        doc = np.empty(len(start), dtype=np.int64)
        order = np.argsort(np.concatenate([self.offsets[:-1], nl + 1]), kind="stable")
        owner = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, nl, "right") - 1])
        doc[:] = owner[order]
        # an empty document and the first byte of the next share a position:
        # order by (document, start)
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        last = np.ones(len(start), dtype=bool)
        last[:-1] = doc[1:] != doc[:-1]
        end = np.empty(len(start), dtype=np.int64)
        end[~last] = start[1:][~last[:-1]] - 1
        end[last] = self.offsets[doc[last] + 1]
        return start, end, doc


class Words:
    """Words (runs of bytes that are not ASCII white space) of a slice."""

    def __init__(self, text: TextSlice, lower: bool, seed: int):
        data = LOWER[text.data] if lower else text.data
        inside = ~SEPARATOR[text.data]
        n = len(data)
        starts, ends = inside.copy(), np.zeros(n + 1, dtype=bool)
        starts[1:] &= ~inside[:-1]
        ends[1:n] = inside[:-1] & ~inside[1:] if n > 1 else False
        if n:
            ends[n] = inside[-1]
        edges = text.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        starts[edges] = inside[edges]
        ends[edges] |= inside[edges - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.doc = np.searchsorted(text.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(text)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # index of each document's first word
        self.hash = ByteHasher(data, seed).ranges(self.start, self.end)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)


def word_windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every window of ``size`` words that lies
    in one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * _U(BASE) + hashes[k:k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    return mix64(total[at] + _U(size)), at


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments bounded by ``first`` (len = segments + 1)."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def text_slices(batch: pa.RecordBatch, column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, TextSlice]]:
    """Row slices of a batch with at most ``max_bytes`` of text (or one row)."""
    index = batch.schema.get_field_index(column)
    whole = TextSlice(batch.column(index))
    at, n = 0, len(whole)
    while at < n:
        to = int(np.searchsorted(whole.offsets, whole.offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        part = batch.slice(at, to - at)
        yield part, TextSlice(part.column(index))
        at = to


def pad_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Only the named columns, with the types the operators expect; whatever
    else the table carries is not read."""
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string"}
    return docs.select(*[F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in columns])
