"""Packing documents into fixed-size sequences (op 9): cutting stock by column
generation.

A document's ids (with the end id) are cut into full sequences and one
remainder.  Remainder lengths are counted in a histogram on a grid of ``GRID``
ids; the number of sequences is minimised by the cutting-stock linear program
whose columns are patterns (how many pieces of each length share a sequence).
Columns are generated: the duals of the current basis price lengths, a knapsack
dynamic program finds the pattern of best value, and it enters the basis until
none pays.  The solution is rounded down, the few pieces left over are placed
first-fit decreasing, and the patterns are dealt to the pieces by their rank
within their length.

What meets on the driver is the histogram and the patterns, both bounded by
capacity / GRID whatever the corpus.  The text is read once, in place, without
a shuffle; ranks are a running count per (partition, length) plus the totals of
the partitions before, so a length that a third of all pieces share is never
gathered in one task.  Only piece rows (no ids, unless asked for) are shuffled,
by their sequence.

Edge cases: null or empty text is one piece with the end id; repeated rows are
packed once each; an empty table packs nothing; a null doc_id stays null;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.textops import pad_documents, text_slices
from keelson.llm.tokens import encoder
from keelson.session import scratch_path

__all__ = ["token_pieces", "generate_patterns", "pack_documents"]

CAPACITY = 2048
END_ID = 1
GRID = 8               # lengths are planned in multiples of this many ids
GAP = 5e-4             # columns are generated until the plan is this close to its lower bound
COLUMNS_PER_SIZE = 12  # ... or so many per length have been priced (the plan is valid at any point)

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "bin int, part int, local_rank long")


def _piece_batches(tokenizer: str, capacity: int, grid: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity // grid + 2, dtype=np.int64)
        for batch in batches:
            for rows, _ in text_slices(batch):
                ids, count = encoder(tokenizer).encode(rows.column(1).to_pylist())
                n = count + 1
                first = np.concatenate([[0], np.cumsum(n)])
                flat = np.full(first[-1], END_ID, dtype="<u4")
                at = np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)
                flat[at] = ids
                pieces = (n + capacity - 1) // capacity
                doc = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * capacity
                length = np.minimum(n[doc] - start, capacity)
                lo = first[doc] + start
                raw = flat.view(np.uint8)
                body = [raw[4 * a:4 * (a + k)].tobytes() for a, k in zip(lo, length)]
                bins = (length + grid - 1) // grid
                order = np.argsort(bins, kind="stable")
                sorted_bins = bins[order]
                run_start = np.searchsorted(sorted_bins, sorted_bins, "left")
                rank = np.empty(len(bins), dtype=np.int64)
                rank[order] = np.arange(len(bins)) - run_start
                rank += seen[bins]
                seen += np.bincount(bins, minlength=len(seen))
                cols = [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                        pa.array([zlib.crc32(x) for x in body], pa.int64()), pa.array(n[doc]),
                        pa.array(bins.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "local_rank"]
                if keep_ids:
                    cols, names = cols + [pa.array(body, pa.binary())], names + ["ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grid: int = GRID,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their planning length (``bin``)
    and their rank among the partition's pieces of that length."""
    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "")
    return pad_documents(docs).mapInArrow(_piece_batches(tokenizer, capacity, grid, keep_ids), schema)


def _best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of sizes 1.. with the largest value."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        gain = best[:c][::-1] + value[:c]        # a piece of size 1..c, then the best of the rest
        j = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[j] > best[c] + 1e-12:
            best[c], take[c] = gain[j], j + 1
    pattern, c = np.zeros(len(value)), capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def generate_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with the number of sequences cut by each; together they hold
    ``demand[s - 1]`` pieces of every size s in 1..capacity."""
    sizes = np.flatnonzero(demand > 0) + 1
    if not len(sizes):
        return []
    d, m = demand[sizes - 1].astype(float), len(sizes)
    basis = np.diag((capacity // sizes).astype(float))   # column j: sequences of one size only
    inverse, x = np.diag(1.0 / np.diag(basis)), d / np.diag(basis)
    true_d, d = d, d * (1 + 1e-3 * np.modf(np.arange(1, m + 1) * 0.618034)[0])   # ties would make the simplex stall
    x, reached, stalled = d / np.diag(basis), np.inf, 0
    bound = float(d @ sizes) / capacity                   # no plan wastes less than nothing
    for _ in range(COLUMNS_PER_SIZE * m):
        dual = inverse.sum(axis=0)                        # every column costs one sequence
        value = np.zeros(capacity)
        value[sizes - 1] = np.maximum(dual, 0)
        worth, pattern = _best_pattern(value, capacity)
        bound = max(bound, x.sum() / max(worth, 1.0))     # duals over worth are feasible
        if x.sum() - bound <= max(1.0, GAP * x.sum()):    # under one sequence is lost in rounding anyway
            break
        stalled = 0 if x.sum() < reached - 1e-4 * max(1.0, GAP * reached) else stalled + 1
        reached = min(reached, x.sum())
        if stalled > 2 * m:
            break
        column = pattern[sizes - 1]
        direction = (inverse * column).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        t = ratio[leave]
        x = np.maximum(x - t * direction, 0)
        x[leave] = t
        basis[:, leave] = column
        row = inverse[leave] / direction[leave]
        inverse -= direction[:, None] * row
        inverse[leave] = row
    x = np.maximum((inverse * true_d).sum(axis=1), 0)
    plan, left = [], demand.astype(np.int64).copy()
    for j in range(m):
        n = int(np.floor(x[j] + 1e-9))
        full = np.zeros(capacity, dtype=np.int64)
        full[sizes - 1] = np.round(basis[:, j]).astype(np.int64)
        while n > 0:                                      # never more slots than pieces
            held = full > 0
            fits = int(min(n, (left[held] // full[held]).min()))
            if fits:
                plan.append((full.copy(), fits))
                left -= full * fits
                n -= fits
            else:
                full = np.minimum(full, left)
                if not full.any():
                    break
    open_bins: list[tuple[int, np.ndarray]] = []
    for size in range(capacity, 0, -1):                   # first-fit decreasing
        for _ in range(int(left[size - 1])):
            for i, (room, pattern) in enumerate(open_bins):
                if room >= size:
                    pattern[size - 1] += 1
                    open_bins[i] = (room - size, pattern)
                    break
            else:
                pattern = np.zeros(capacity, dtype=np.int64)
                pattern[size - 1] = 1
                open_bins.append((capacity - size, pattern))
    return plan + [(p, 1) for _, p in open_bins]


def _slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, past last rank, pieces per sequence, first sequence)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, copies in plan:
        for size in np.flatnonzero(pattern) + 1:
            a = int(pattern[size - 1])
            lo = taken.get(int(size), 0)
            taken[int(size)] = lo + a * copies
            rows.append((int(size), lo, lo + a * copies, a, sequence))
        sequence += copies
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grid: int = GRID,
                   keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ``ids``, little-endian unsigned 32-bit, on request)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "packing")
    token_pieces(docs, tokenizer, capacity, grid, keep_ids).write.parquet(path)
    pieces = spark.read.parquet(path)
    per_part = pieces.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity // grid, dtype=np.int64)
    for row in per_part.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most capacity / grid rows
        histogram[row["bin"] - 1] = row["n"]
    slots = spark.createDataFrame(_slots(generate_patterns(histogram, capacity // grid)),
                                  "bin int, lo long, hi long, per_sequence long, first_sequence long")
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "bin"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    # bounded: at most a few thousand (length, pattern) rows whatever the corpus
    placed = (ranked.join(F.broadcast(slots), (ranked["bin"] == slots["bin"])
                          & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", ranked["bin"].alias("bin"), "rank",
                      *(["ids"] if keep_ids else []),
                      (F.col("first_sequence") + F.floor((F.col("rank") - F.col("lo")) / F.col("per_sequence")))
                      .cast("long").alias("sequence_id")))
    inside = (Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rank")
              .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
                         *(["ids"] if keep_ids else []))
