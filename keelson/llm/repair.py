"""Token-id output (op 6): Re-Pair grammar compression with random access.

Documents are encoded and written in ascending doc_id order.  A file row holds
a block of whole documents as one Re-Pair grammar: frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round, until no
pair is frequent enough or, where the ids fit 16 bits, its symbols are used
up; larger ids take symbols of 32 bits.  No rule crosses the end of a document.  With the rules the block stores the expansion length of
every nonterminal, so a range of ids is decoded by summing lengths and expanding
only the symbols that cover the range.

Block layout (little-endian): magic ``RPR1``, then unsigned 32-bit first
nonterminal, rules, symbols, documents and symbol bytes (2 or 4); rules as
pairs of u32; expansion lengths as u32; ids per document as u32; symbols.

Plan: the text is range-partitioned by doc_id once (a partition is a shard),
encoded, compressed and written through Spark's Parquet writer, whose commit
survives lost executors.  Starts come from per-block totals: a running sum
within the shard plus the totals of the shards before it.

Edge cases: null or empty text is the end id alone; repeated doc_ids are
ordered by text and each written; an empty table writes no block; a null doc_id
sorts first; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.textops import pad_documents, text_slices
from keelson.llm.tokens import encoder

__all__ = ["compress", "decompress", "decode_range", "write_token_files", "read_token_files"]

END_ID = 1
BLOCK_IDS = 1 << 20
PAIRS_PER_ROUND = 16384
MIN_COUNT = 12         # rarer pairs are not replaced
MAGIC = b"RPR1"
_HEAD = "<4s5I"

BLOCK_SCHEMA = "shard int, block int, n_docs int, n_ids long, doc_ids binary, null_ids binary, payload binary"


def _choose(keys: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent pairs that can be replaced in one pass: no symbol is
    the left of one and the right of another (a pair of equal symbols shares its
    symbol with no other), and their table slots differ."""
    order = np.argsort(-counts, kind="stable")[:limit]
    left: set[int] = set()
    right: set[int] = set()
    slots: set[int] = set()
    out = []
    for key, slot in zip(keys[order].tolist(), _slot(keys[order]).tolist()):
        a, b = key >> 32, key & 0xFFFFFFFF
        if a in right or b in left or (a == b and a in left) or slot in slots:
            continue
        left.add(a)
        right.add(b)
        slots.add(slot)
        out.append(key)
    return np.array(out, dtype=np.int64)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def compress(ids: np.ndarray, doc_ids_count: np.ndarray, end_id: int = END_ID, rounds: int | None = None,
             min_count: int = MIN_COUNT) -> bytes:
    """Re-Pair block of the documents' ids (each document ends with end_id).
    Rounds go on until no pair is frequent (or for ``rounds``); where ids fit 16
    bits, nonterminals take the symbols left there and rounds end with them."""
    seq = ids.astype(np.int64)
    first = int(seq.max()) + 1 if len(seq) else 0
    room = 65536 - first if first < 65536 else 1 << 31
    rules: list[np.ndarray] = []
    lengths = np.ones(first, dtype=np.int64)
    boundary = np.zeros(len(seq), dtype=bool)   # last id of a document: no pair starts here
    boundary[np.cumsum(doc_ids_count) - 1] = True
    done, fresh = 0, 0
    frequent = np.ones(1 << 16, dtype=bool)     # slots that may hold a frequent pair
    while len(seq) > 1 and room > 0 and done != rounds:
        done += 1
        key = (seq[:-1] << 32) | seq[1:]
        key[boundary[:-1]] = -1
        slot = _slot(key)
        # counts only fall: a pair without a symbol of the last round that was rare stays rare
        s = np.sort(key if done == 1 else key[(seq[:-1] >= fresh) | (seq[1:] >= fresh) | frequent[slot]])
        if not len(s):
            break
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([edge, [len(s)]]))
        same = (s[edge] >> 32) == (s[edge] & 0xFFFFFFFF)
        count = np.where(same, count // 2, count)         # in a run every other pair is replaced
        often = (count >= min_count) & (s[edge] >= 0)
        chosen = _choose(s[edge][often], count[often], min(PAIRS_PER_ROUND, room))
        if not len(chosen):
            break
        frequent = np.zeros(1 << 16, dtype=bool)
        frequent[_slot(s[edge][often])] = True
        fresh = len(lengths)
        table = np.full(1 << 16, -2, dtype=np.int64)
        symbol = np.zeros(1 << 16, dtype=np.int64)
        table[_slot(chosen)] = chosen
        symbol[_slot(chosen)] = len(lengths) + np.arange(len(chosen))
        hit = np.flatnonzero(table[slot] == key)
        run = np.flatnonzero((key[hit] >> 32) == (key[hit] & 0xFFFFFFFF))
        if len(run):                                      # pairs of equal symbols overlap in a run
            begins = np.ones(len(run), dtype=bool)
            begins[1:] = (hit[run[1:]] != hit[run[:-1]] + 1) | (key[hit[run[1:]]] != key[hit[run[:-1]]])
            offset = np.arange(len(run)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hit = np.delete(hit, run[offset % 2 == 1])
        seq[hit] = symbol[slot[hit]]
        boundary[hit] = boundary[hit + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[hit + 1] = False
        seq, boundary = seq[keep], boundary[keep]
        pair = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)
        rules.append(pair)
        lengths = np.concatenate([lengths, lengths[pair[:, 0]] + lengths[pair[:, 1]]])
        room -= len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    wide = 4 if first + len(table) > 65536 else 2
    return b"".join([
        struct.pack(_HEAD, MAGIC, first, len(table), len(seq), len(doc_ids_count), wide),
        table.astype("<u4").tobytes(), lengths[first:].astype("<u4").tobytes(),
        doc_ids_count.astype("<u4").tobytes(), seq.astype("<u2" if wide == 2 else "<u4").tobytes()])


def _parse(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, first, n_rules, n_symbols, n_docs, wide = struct.unpack_from(_HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a Re-Pair block")
    at = struct.calcsize(_HEAD)
    rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
    at += 8 * n_rules
    lengths = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
    at += 4 * n_rules
    counts = np.frombuffer(blob, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    seq = np.frombuffer(blob, f"<u{wide}", n_symbols, at).astype(np.int64)
    return first, rules, lengths, counts, seq


def _expand(seq: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """The ids of a sequence: each nonterminal in it is expanded once, and the
    expansions are laid out in one pass."""
    used, which = np.unique(seq, return_inverse=True)
    flat, size = _expansions(used, first, rules)
    start, size = (np.cumsum(size) - size)[which], size[which]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _expansions(seq: np.ndarray, first: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all symbols one after another, ids per symbol)."""
    owner = np.arange(len(seq))
    while True:
        big = seq >= first
        if not big.any():
            return seq, np.bincount(owner)
        at = np.cumsum(1 + big) - 1 - big        # where each symbol's expansion begins
        out = np.empty(len(seq) + int(big.sum()), dtype=np.int64)
        out[at[~big]] = seq[~big]
        pair = rules[seq[big] - first]
        out[at[big]] = pair[:, 0]
        out[at[big] + 1] = pair[:, 1]
        seq, owner = out, np.repeat(owner, 1 + big)


def decompress(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids per document) of a block."""
    first, rules, _, counts, seq = _parse(blob)
    return _expand(seq, first, rules).astype(np.uint32), counts


def decode_range(blob: bytes, start: int, end: int) -> np.ndarray:
    """Ids start..end of a block, expanding only the symbols that cover them."""
    first, rules, lengths, _, seq = _parse(blob)
    size = np.ones(len(seq), dtype=np.int64)
    big = seq >= first
    size[big] = lengths[seq[big] - first]
    ends = np.cumsum(size)
    lo = int(np.searchsorted(ends, start, "right"))
    hi = int(np.searchsorted(ends, end, "left")) + 1
    base = int(ends[lo] - size[lo]) if lo < len(seq) else 0
    return _expand(seq[lo:hi], first, rules)[start - base:end - base].astype(np.uint32)


def _block(shard: int, block: int, doc_ids: list, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    keys = pa.concat_arrays(doc_ids)
    missing = np.asarray(keys.is_null()).astype(np.uint8) if keys.null_count else np.zeros(len(keys), np.uint8)
    values = np.asarray(keys.fill_null(0)).astype("<i8")
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(keys)], pa.int32()),
         pa.array([len(ids)], pa.int64()), pa.array([values.tobytes()], pa.binary()),
         pa.array([missing.tobytes()], pa.binary()), pa.array([compress(ids, counts)], pa.binary())],
        names=["shard", "block", "n_docs", "n_ids", "doc_ids", "null_ids", "payload"])


def _write_batches(tokenizer: str, block_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        doc_ids: list[pa.Array] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for rows, _ in text_slices(batch, max_bytes=1 << 20):
                ids, count = encoder(tokenizer).encode(rows.column(1).to_pylist())
                first = np.cumsum(count + 1)
                flat = np.full(int(first[-1]), END_ID, dtype=np.uint32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                doc_ids.append(rows.column(0))
                parts.append((flat, count + 1))
                held += len(flat)
                if held >= block_ids:
                    yield _block(shard, block, doc_ids, parts)
                    doc_ids, parts, held, block = [], [], 0, block + 1
        if parts:
            yield _block(shard, block, doc_ids, parts)
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write Re-Pair blocks in ascending doc_id order."""
    ordered = pad_documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_batches(tokenizer, block_ids), BLOCK_SCHEMA).write.parquet(path)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, doc_ids, null_ids, payload = (batch.column(i).to_pylist() for i in range(4))
        for b, d, z, blob in zip(base, doc_ids, null_ids, payload):
            ids, counts = decompress(blob)
            raw = ids.astype("<u4").view(np.uint8)
            ends = np.cumsum(counts)
            starts = ends - counts
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            key = pa.array(np.frombuffer(d, "<i8"), mask=np.frombuffer(z, np.uint8).astype(bool))
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(starts + b), pa.array(counts), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    # one row per shard: the totals of the shards before it
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", "n_ids").withColumn(
        "block_base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    bases = sizes.join(shards, "shard").select("shard", "block", (F.col("shard_base") + F.col("block_base")).alias("base"))
    return (blocks.join(bases, ["shard", "block"]).select("base", "doc_ids", "null_ids", "payload")
            .mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long"))
