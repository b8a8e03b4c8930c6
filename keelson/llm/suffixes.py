"""Exact substring removal (op 1): blockwise suffix sorting with a difference
cover.

Wanted is, for every suffix, whether an equal prefix of WIDTH bytes starts
earlier in the corpus.  Suffixes are sorted in buckets (ranges of the key order)
one bucket at a time, and a difference cover decides which suffixes need it:

* cover D modulo V: for any two positions i, j some shift below V puts both
  i + shift and j + shift into the sample (positions whose offset in the
  document is in D modulo V).  If the WIDTH-byte prefixes at i and j are equal,
  so are the (WIDTH - V + 1)-byte prefixes of those two samples;
* the samples (8 of 57 positions) are ranked first, by that shorter prefix.  A
  suffix none of whose samples ties with another cannot tie for WIDTH bytes and
  is done;
* the rest, the long ties, are sorted by their whole WIDTH-byte key.  The first
  suffix of a tie by (doc_id, start) stays, the others are repeats.

Only equality of prefixes counts, so the key order is the order of 64-bit
fingerprints of the prefixes: it spreads any text evenly over the buckets, and
ranks are exact up to fingerprint collisions (about 2**-64 per pair of
different strings; the table of samples may collide, which only adds work).

Plan: documents are packed once into compressed blocks of about BLOCK_BYTES of
text, a bucketed table, so later passes join their flags to it without moving
the text.  Exact copies of whole documents are found by signature and leave
first.  Per block and bucket one row of sorted, delta-coded keys is shuffled,
with one entry per distinct key: a passage that a third of all documents share
is at most one entry per block.  Buckets are sized from the measured bytes, so a
task holds one bucket of a fixed size for every corpus; answers come back as one
bit per entry.

Edge cases: null or empty text has no bytes; documents shorter than WIDTH keep
everything; of rows that repeat a doc_id the one packed first counts as earlier,
so repeated rows lose all their text but once; a null doc_id sorts before all
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.blocks import (BLOCK_BYTES, ENTRY_SCHEMA, NULL_ID, Block, KeyRuns, blocks_of, by_bucket, deltas, entry_rows,
                                pack, unpack, write_blocks)
from keelson.llm.textops import ByteHasher, mix64
from keelson.session import scratch_path

__all__ = ["DIFFERENCE_COVER", "COVER_PERIOD", "repeated_bytes", "remove_repeats"]

WIDTH = 100
COVER_PERIOD = 57
#: Every difference modulo 57 occurs between two of these (a perfect difference set).
DIFFERENCE_COVER = (1, 6, 7, 9, 19, 38, 42, 49)
BUCKET_BYTES = 8 << 20   # bytes of text per bucket: bounds the suffixes that one task sorts
SPARE_BITS = 10           # sample keys: log2(bytes) + this many bits

BITS_SCHEMA = "block_id long, bucket int, bits binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Block(Block):
    """A block with the positions of its suffixes."""

    def runs(self, width: int) -> np.ndarray:
        """Flags of the positions where ``width`` bytes of a live document start."""
        n = len(self.data)
        step = np.zeros(n + 1, dtype=np.int32)
        ok = ~self.dropped & (self.lengths >= width)
        np.add.at(step, self.starts[ok], 1)
        np.add.at(step, self.ends[ok] - width + 1, -1)
        return np.cumsum(step[:-1]) > 0

    def samples(self) -> np.ndarray:
        """Positions in the cover whose shorter prefix lies in the document."""
        short = WIDTH - COVER_PERIOD + 1
        table = np.zeros(COVER_PERIOD, dtype=bool)
        table[list(DIFFERENCE_COVER)] = True
        offset = (np.arange(len(self.data)) - np.repeat(self.starts, self.lengths)) % COVER_PERIOD
        return np.flatnonzero(table[offset] & self.runs(short))

    def keys(self, hasher: ByteHasher, at: np.ndarray, width: int) -> np.ndarray:
        return hasher.ranges(at, at + width)


def _sample_keys(block: _Block, hasher: ByteHasher, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = block.samples()
    return at, block.keys(hasher, at, WIDTH - COVER_PERIOD + 1) >> np.uint64(64 - bits)


# ------------------------------------------------- pass 1: ranks of the samples

def _sample_batches(bits: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, dropped in blocks_of(batch, 5):
                block = _Block(doc_ids, lengths, body, dropped)
                _, keys = _sample_keys(block, ByteHasher(block.data), bits)
                keys = np.unique(keys)
                rows = [(k, pack(deltas(keys[a:b], lower))) for k, a, b, lower in KeyRuns(keys, bits, buckets)]
                if rows:
                    yield entry_rows(block_id, rows)
    return run


def _bits_batch(bucket: int, blocks: list[int], sizes: list[int], flags: np.ndarray) -> pa.RecordBatch:
    cut = np.cumsum([0] + sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()),
         pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
        names=["block_id", "bucket", "bits"])


def _rank_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: which sample keys stand in two blocks or more."""
    for bucket, blocks, entries in by_bucket(batches):
        parts = [np.cumsum(unpack(blob)[0]) for blob in entries]   # from the lower bound: same for all
        sizes = [len(p) for p in parts]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        tie = np.zeros(len(s), dtype=bool)
        same = s[1:] == s[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        flags = np.zeros(len(s), dtype=bool)
        flags[order] = tie
        yield _bits_batch(bucket, blocks, sizes, flags)


# ------------------------------------------------------- pass 2: the long ties

def _answers(runs: KeyRuns, answers: list[dict] | None) -> np.ndarray:
    """One flag per sorted distinct key from the buckets' bits."""
    out = np.zeros(runs.total, dtype=bool)
    for row in answers or []:
        a, b = runs.find(row["bucket"])
        out[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).astype(bool)
    return out


def _long_ties(block: _Block, hasher: ByteHasher, bits: int, buckets: int, answers: list[dict] | None) -> np.ndarray:
    """Positions whose WIDTH-byte prefix may occur elsewhere."""
    at, keys = _sample_keys(block, hasher, bits)
    distinct, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    tied = (_answers(KeyRuns(distinct, bits, buckets), answers) | (count > 1))[inverse]
    step = np.zeros(len(block.data) + 1, dtype=np.int32)
    hit = at[tied]
    np.add.at(step, np.maximum(hit - COVER_PERIOD + 1, 0), 1)
    np.add.at(step, hit + 1, -1)
    return np.flatnonzero((np.cumsum(step[:-1]) > 0) & block.runs(WIDTH))


def _suffix_keys(block: _Block, hasher: ByteHasher, at: np.ndarray, buckets: int):
    """Sorted distinct keys of the long ties, the first position of each, which
    key each position has, and the keys' buckets."""
    keys = block.keys(hasher, at, WIDTH)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return s[new], at[order[new]], which, KeyRuns(s[new], 64, buckets)


def _tie_batches(bits: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, dropped, answers in blocks_of(batch, 6):
                block = _Block(doc_ids, lengths, body, dropped)
                hasher = ByteHasher(block.data)
                at = _long_ties(block, hasher, bits, buckets, answers)
                keys, first, _, runs = _suffix_keys(block, hasher, at, buckets)
                doc = np.searchsorted(block.ends, first, "right")
                rows = []
                for k, a, b, lower in runs:
                    used, local = np.unique(doc[a:b], return_inverse=True)
                    body_part = pack(deltas(keys[a:b], lower), local.astype(np.uint64))
                    ids = pack((block.ids[used].astype(np.int64) - NULL_ID).view(np.uint64))
                    rows.append((k, len(body_part).to_bytes(4, "little") + body_part + ids))
                if rows:
                    yield entry_rows(block_id, rows)
    return run


def _sort_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: which entries are not the first suffix of their tie."""
    for bucket, blocks, entries in by_bucket(batches):
        keys, docs, owner, sizes = [], [], [], []
        for block_id, blob in zip(blocks, entries):
            n = int.from_bytes(blob[:4], "little")
            delta, local = unpack(blob[4:4 + n])
            ids = unpack(blob[4 + n:])[0]
            keys.append(np.cumsum(delta))
            docs.append(ids[local.astype(np.int64)])
            owner.append(np.full(len(delta), block_id, dtype=np.int64))
            sizes.append(len(delta))
        key = np.concatenate(keys)
        order = np.lexsort((np.concatenate(owner), np.concatenate(docs), key))
        s = key[order]
        later = np.zeros(len(s), dtype=bool)
        later[1:] = s[1:] == s[:-1]
        flags = np.zeros(len(s), dtype=bool)
        flags[order] = later
        yield _bits_batch(bucket, blocks, sizes, flags)


# ---------------------------------------------------------- pass 3: the result

def _covered(block: _Block, at: np.ndarray) -> np.ndarray:
    step = np.zeros(len(block.data) + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + WIDTH, -1)
    gone = np.cumsum(step[:-1]) > 0
    for i in np.flatnonzero(block.dropped & (block.lengths >= WIDTH)):
        gone[block.starts[i]:block.ends[i]] = True
    return gone


def _result_batches(bits: int, buckets: int, keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, dropped, answers, verdicts in blocks_of(batch, 7):
                block = _Block(doc_ids, lengths, body, dropped)
                hasher = ByteHasher(block.data)
                at = _long_ties(block, hasher, bits, buckets, answers)
                _, first, which, runs = _suffix_keys(block, hasher, at, buckets)
                repeat = _answers(runs, verdicts)[which] | (at != first[which])
                gone = _covered(block, at[repeat])
                total = np.concatenate([[0], np.cumsum(gone)])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = block.starts[(block.starts > 0) & (block.lengths > 0)]
                begin[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(begin)])
                kept = []
                for a, b in zip(block.starts.tolist(), block.ends.tolist()):
                    part = block.data[a:b]
                    kept.append((part if total[a] == total[b] else part[~gone[a:b]]).tobytes())
                cols = [pa.array(block.ids, mask=block.ids == NULL_ID), pa.array(block.lengths),
                        pa.array(total[block.ends] - total[block.starts]),
                        pa.array(spans[block.ends] - spans[block.starts]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    cols, names = cols + [pa.array(kept, pa.binary())], names + ["kept"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block_id, doc_ids, lengths, body in blocks_of(batch, 4):
            block = _Block(doc_ids, lengths, body, None)
            one = ByteHasher(block.data, 11).ranges(block.starts, block.ends).view(np.int64)
            two = mix64(ByteHasher(block.data, 12).ranges(block.starts, block.ends)).view(np.int64)
            n = len(block.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids), pa.array(np.full(n, block_id)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(block.lengths), pa.array(one), pa.array(two)],
                names=["doc_id", "block_id", "nth", "n_bytes", "sig1", "sig2"])


def _whole_copies(blocks: DataFrame) -> DataFrame:
    """(block_id, dropped): documents equal to an earlier one, per block."""
    docs = blocks.select("block_id", "doc_ids", "lengths", "body").mapInArrow(
        _signature_batches, "doc_id long, block_id long, nth int, n_bytes long, sig1 long, sig2 long")
    docs = docs.where(F.col("n_bytes") >= WIDTH)
    key = ["n_bytes", "sig1", "sig2"]
    first = (docs.groupBy(*key).agg(F.min(F.struct("doc_id", "block_id", "nth")).alias("first"), F.count(F.lit(1)).alias("c"))
             .where("c > 1"))
    later = docs.join(first, key).where(F.struct("doc_id", "block_id", "nth") != F.col("first"))
    return later.groupBy("block_id").agg(F.collect_list("nth").alias("dropped"))


def repeated_bytes(docs: DataFrame, keep_text: bool = False, block_bytes: int = BLOCK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the
    remaining bytes, on request)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "suffixes")
    blocks = write_blocks(docs, block_bytes)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    bits = min(62 - buckets.bit_length(), max(16, int(total).bit_length() + SPARE_BITS))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    def through_buckets(entries: DataFrame, fn: Callable) -> DataFrame:
        sorted_rows = entries.repartition("bucket").sortWithinPartitions("bucket", "block_id")
        return sorted_rows.mapInArrow(fn, BITS_SCHEMA)

    def per_block(answers: DataFrame, name: str) -> DataFrame:   # one row per bucket and block
        return answers.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    copies = written(_whole_copies(blocks), "copies")
    with_copies = blocks.join(copies.hint("shuffle_hash"), "block_id", "left")
    body = ["block_id", "doc_ids", "lengths", "body", "dropped"]
    samples = with_copies.select(*body).mapInArrow(_sample_batches(bits, buckets), ENTRY_SCHEMA)
    ranks = written(through_buckets(samples, _rank_samples), "ranks")
    with_ranks = with_copies.join(per_block(ranks, "answers").hint("shuffle_hash"), "block_id", "left")
    ties = with_ranks.select(*body, "answers").mapInArrow(_tie_batches(bits, buckets), ENTRY_SCHEMA)
    verdicts = written(through_buckets(ties, _sort_ties), "verdicts")
    last = with_ranks.join(per_block(verdicts, "verdicts").hint("shuffle_hash"), "block_id", "left")
    return last.select(*body, "answers", "verdicts").mapInArrow(
        _result_batches(bits, buckets, keep_text), RESULT_SCHEMA + (", kept binary" if keep_text else ""))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text that remains (bytes cut inside a character are
    replaced when decoded)."""
    return repeated_bytes(docs, keep_text=True).select("doc_id", F.decode("kept", "UTF-8").alias("text"))
