"""Text blocks: the corpus packed once, and packed rows exchanged by bucket.

Operators that compare every place of every text with all others read the text
several times and exchange compact keys in between.  Documents are packed into
compressed blocks of a few MB, a table bucketed by block_id, so passes join
their answers to the blocks without moving the text.  Keys travel as one row
per (block, bucket): sorted, delta-coded byte planes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.textops import TextSlice, pad_documents, text_slices
from keelson.session import checkpoint_dir, release

__all__ = ["BLOCK_BYTES", "NULL_ID", "ENTRY_SCHEMA", "pack", "unpack", "new_block_table", "write_blocks", "drop_blocks", "Block", "KeyRuns", "deltas",
           "entry_rows", "blocks_of", "by_bucket"]

BLOCK_BYTES = 2 << 20   # a worker holds about 60 bytes for every byte of a block
BUCKET_TEXT = 16 << 20  # bytes of text in a bucket of the block table
NULL_ID = np.iinfo(np.int64).min
BLOCK_SCHEMA = "block_id long, n_bytes long, doc_ids binary, lengths binary, body binary"
ENTRY_SCHEMA = "bucket int, block_id long, entries binary"


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned columns of one length as compressed byte planes."""
    import zstandard
    out = [np.array([len(columns[0]) if columns else 0, len(columns)], "<u4").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        wide = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        out.append(bytes([wide]))
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, "<u4", 2)
    at, out = 8, []
    for _ in range(int(k)):
        wide = raw[at]
        planes = np.frombuffer(raw, np.uint8, int(n) * wide, at + 1).reshape(wide, int(n))
        full = np.zeros((int(n), 8), dtype=np.uint8)
        full[:, :wide] = planes.T
        out.append(full.view("<u8").reshape(-1))
        at += 1 + int(n) * wide
    return out


def _block_batches(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, text in text_slices(batch, max_bytes=block_bytes):
                ids = np.asarray(rows.column(0).fill_null(NULL_ID))
                order = np.argsort(ids, kind="stable")
                if (order[1:] < order[:-1]).any():
                    rows = rows.take(pa.array(order))
                    text, ids = TextSlice(rows.column(1)), ids[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + nth], pa.int64()), pa.array([len(text.data)], pa.int64()),
                     pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                     pa.array([text.lengths().astype("<i8").tobytes()], pa.binary()),
                     pa.array([zstandard.ZstdCompressor(level=3).compress(text.data.tobytes())], pa.binary())],
                    names=["block_id", "n_bytes", "doc_ids", "lengths", "body"])
                nth += 1
    return run


def new_block_table() -> str:
    return f"text_blocks_{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/keelson/{name}"


def write_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, name: str | None = None) -> DataFrame:
    """The corpus as a table of compressed blocks, bucketed by block_id so that
    joins on block_id read it in place.  The number of buckets follows the bytes
    of text; it is no smaller than the number of shuffle partitions, below which
    Spark would shuffle the blocks to join them."""
    spark = docs.sparkSession
    name, padded = name or new_block_table(), pad_documents(docs)
    total = padded.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_TEXT))
    (padded.mapInArrow(_block_batches(block_bytes), BLOCK_SCHEMA)
     .write.format("parquet").option("path", _folder(spark, name)).bucketBy(buckets, "block_id").saveAsTable(name))
    return spark.table(name)


def drop_blocks(spark: SparkSession, name: str) -> None:
    """Drop a block table and its files, once what was made from it is written."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    release(spark, _folder(spark, name))


class Block:
    """One block's documents; ``dropped`` marks those to leave out."""

    def __init__(self, doc_ids: bytes, lengths: bytes, body: bytes, dropped: list[int] | None = None):
        import zstandard
        self.ids = np.frombuffer(doc_ids, "<i8")
        self.lengths = np.frombuffer(lengths, "<i8")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.dropped = np.zeros(len(self.ids), dtype=bool)
        if dropped:
            self.dropped[dropped] = True

    def text(self) -> TextSlice:
        out = TextSlice(pa.array([], pa.string()))
        out.data, out.offsets = self.data, np.concatenate([[0], self.ends]).astype(np.int64)
        return out


class KeyRuns:
    """Sorted keys cut into buckets, equal ranges of the key space; only buckets
    that hold a key are listed, so the work follows the keys."""

    def __init__(self, keys: np.ndarray, bits: int, buckets: int):
        wide = min(bits, 32)
        top = keys >> np.uint64(bits - wide)
        bucket = ((top * np.uint64(buckets)) >> np.uint64(wide)).astype(np.int64)
        self.total = len(keys)
        self.start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.end = np.concatenate([self.start[1:], [len(keys)]]).astype(np.int64) if len(keys) else self.start
        self.bucket = bucket[self.start]
        self._bits, self._wide, self._buckets = bits, wide, buckets

    def __iter__(self) -> Iterator[tuple[int, int, int, np.uint64]]:
        """(bucket, first key, past last key, lower bound of the bucket)."""
        for b, lo, hi in zip(self.bucket.tolist(), self.start.tolist(), self.end.tolist()):
            yield b, lo, hi, np.uint64(-(-(b << self._wide) // self._buckets) << (self._bits - self._wide))

    def find(self, bucket: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.bucket, bucket))
        return int(self.start[i]), int(self.end[i])


def entry_rows(block_id: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([block_id] * len(rows), pa.int64()),
         pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block_id", "entries"])


def deltas(keys: np.ndarray, lower: np.uint64) -> np.ndarray:
    return np.diff(np.concatenate([[lower], keys]).astype(np.uint64))


def blocks_of(batch: pa.RecordBatch, columns: int) -> Iterator[list]:
    for i in range(batch.num_rows):   # one block in memory at a time
        yield [batch.column(k)[i].as_py() for k in range(columns)]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Rows sorted by bucket, one bucket at a time."""
    now, blocks, entries = None, [], []
    for batch in batches:
        for bucket, block_id, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if bucket != now and blocks:
                yield now, blocks, entries
                blocks, entries = [], []
            now = bucket
            blocks.append(block_id)
            entries.append(blob)
    if blocks:
        yield now, blocks, entries
