"""Exact top-k search (op 3): incremental multi-index hashing of binary codes.

A vector becomes a 64-bit code: the sign of every coordinate, or of 64 hashed
+-1 projections where it has more.  Codes are cut into m segments of about
log2(codes) - 3 bits, and every code is indexed under each segment's value.  Round r
probes, for every open query and segment, the values at Hamming distance exactly
r; after it every code within m * (r + 1) - 1 of the query has been met
(pigeonhole), so a query whose kth verified distance is no more than that is
done, ties included.  Others go on to r + 1, where a query with kth distance b
so far needs only its first b - m * r + 1 segments: they cover distance b.

Equal codes share one index entry with their k + 1 smallest ids (all that a
top k can need), so a vector that a third of all rows repeat is one entry.
Distances are verified inside the join, against the query's current kth
distance, so what leaves it is what may still enter a result.  Every round is
written to the shared scratch folder.

Edge cases: null or empty vectors are neither indexed nor searched; a short
vector counts as padded with zeros (bit 0); ties go to the smaller id; a query
and rows that repeat its id are not neighbours, rows that share its code are; fewer than k
other rows give fewer neighbours; an empty table gives an empty result; columns
other than id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.textops import mix64
from keelson.session import scratch_path

__all__ = ["binary_codes", "segment_widths", "nearest_codes"]

BITS = 64
K = 10
MAX_SEGMENT = 20      # widest segment: bounds the probes of a round


def _code_batches(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(1)
            size = np.asarray(pa.compute.list_value_length(vec).fill_null(0)).astype(np.int64)
            keep = np.flatnonzero(size > 0)
            width = int(size.max()) if len(size) else 0
            full = np.zeros((len(size), max(width, BITS)), dtype=np.float64)
            flat = np.asarray(vec.flatten().fill_null(0.0), dtype=np.float64)
            row = np.repeat(np.arange(len(size)), size)
            full[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            codes = np.zeros(len(size), dtype=np.uint64)
            wide = size > BITS
            for bit in range(BITS):
                value = full[:, bit]
                if wide.any():
                    signs = np.where(mix64(np.arange(full.shape[1], dtype=np.uint64) * np.uint64(BITS) + np.uint64(bit + seed))
                                     >> np.uint64(63), 1.0, -1.0)
                    value = np.where(wide, full @ signs, value)
                codes |= (value > 0).astype(np.uint64) << np.uint64(bit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(codes[keep].view(np.int64))],
                                             names=["id", "code"])
    return run


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str, seed: int = 0) -> DataFrame:
    """(id, code): one 64-bit code per vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec"))
    return rows.mapInArrow(_code_batches(seed), "id long, code long")


def segment_widths(n_codes: int) -> list[int]:
    """Widths of the segments: log2(n_codes) - 3 bits or so, which leaves several
    codes to a value and far fewer values to probe."""
    want = min(MAX_SEGMENT, max(4, round(math.log2(max(2, n_codes))) - 3))
    m = max(1, round(BITS / want))
    return [BITS * (i + 1) // m - BITS * i // m for i in range(m)]


def _segments(code: str, widths: list[int]) -> Column:
    shifts = [sum(widths[:i]) for i in range(len(widths))]
    return F.array(*[F.struct(F.lit(i).alias("segment"),
                              F.shiftrightunsigned(code, s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
                     for i, (s, w) in enumerate(zip(shifts, widths))])


def _masks(widths: list[int], radius: int) -> list[tuple[int, int]]:
    return [(i, sum(1 << b for b in bits)) for i, w in enumerate(widths) for bits in combinations(range(w), radius)]


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the exact k nearest other rows of
    every query; ``queries`` are rows of ``codes`` (id, code)."""
    spark = codes.sparkSession
    path = scratch_path(spark, "search")
    keep = k + 1                                          # the query itself may be among them
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    groups = (codes.select("id", "code").distinct().withColumn("nth", nth).where(F.col("nth") <= keep)
              .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    groups.write.parquet(f"{path}/codes")
    groups = spark.read.parquet(f"{path}/codes")
    widths = segment_widths(groups.count())
    index = (groups.select("code", "ids", F.explode(_segments("code", widths)).alias("s"))
             .select("code", "ids", "s.segment", "s.value"))
    index.write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    queries.select("id", "code").write.parquet(f"{path}/queries")
    queries = spark.read.parquet(f"{path}/queries")
    open_codes = queries.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS))
    best, done, radius = None, None, 0
    while True:
        masks = spark.createDataFrame(_masks(widths, radius), "segment int, mask long")   # bounded by MAX_SEGMENT
        probes = (open_codes.select("query", "bound", F.explode(_segments("query", widths)).alias("s"))
                  .select("query", "bound", "s.segment", F.col("s.value").alias("own"))
                  .where(F.col("segment") <= F.col("bound") - F.lit(len(widths) * radius))
                  .join(F.broadcast(masks), "segment")
                  .select("query", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")).alias("p"))
        distance = F.bit_count(F.col("p.query").bitwiseXOR(F.col("x.code")))
        met = probes.join(index.alias("x"), (F.col("p.segment") == F.col("x.segment")) & (F.col("p.value") == F.col("x.value"))
                          & (distance <= F.col("p.bound")))
        found = met.select("query", distance.alias("distance"), F.explode("x.ids").alias("id"))
        if best is not None:
            found = found.unionByName(best.join(open_codes.select("query"), "query", "left_semi"))
        order = Window.partitionBy("query").orderBy("distance", "id")
        ranked = found.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")
        ranked.write.parquet(f"{path}/best/{radius}")
        best = spark.read.parquet(f"{path}/best/{radius}")
        covered = len(widths) * (radius + 1) - 1
        state = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        last = radius >= max(widths)
        # covered by all segments, or by those that the bound before this round asked for
        asked = open_codes.select("query", "bound")
        closed = state.join(asked, "query").where(
            F.lit(last) | ((F.col("n") >= keep) & ((F.col("kth") <= covered) | (F.col("bound") <= covered))))
        result = best.join(closed.select("query"), "query", "left_semi")
        done = result if done is None else done.unionByName(result)
        open_codes = (open_codes.select("query").join(closed.select("query"), "query", "left_anti")
                      .join(state, "query", "left")
                      .select("query", F.when(F.col("n") >= keep, F.col("kth")).otherwise(BITS).alias("bound")))
        open_codes.write.parquet(f"{path}/open/{radius}")
        open_codes = spark.read.parquet(f"{path}/open/{radius}")
        radius += 1
        if last or open_codes.isEmpty():
            break
    hits = (queries.alias("q").join(done.alias("d"), F.col("q.code") == F.col("d.query"))
            .where(F.col("q.id") != F.col("d.id"))
            .select(F.col("q.id").alias("query_id"), F.col("d.id").alias("neighbor_id"), "d.distance").distinct())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
