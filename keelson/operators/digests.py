"""Change feed between two snapshots by digests: only what differs is read.

A snapshot is written in folders by key bucket, with a digest of every bucket
(row count, exclusive-or and sum of row hashes: independent of row order) and of
groups of FANOUT buckets above it.  Two snapshots are compared from the top: a
node with equal digests is dropped with all that is below it.  The full outer
join of ``changes.change_feed`` then reads the differing buckets only, filtered
by literals.

Buckets come from the key, by a hash or by a given column.  A hash spreads any
change over all buckets; where changes are local in the key (recent ids, recent
days), a range such as ``floor(id / width)`` keeps them in few.  The numbers of
differing buckets, at most the number of buckets, are the only rows that reach
the driver.

Row hashes tell null from absent and cover all columns by name; two different
buckets agree by chance with probability about 2**-64.  Map columns have no hash and
must be turned to text first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.changes import change_feed
from keelson.sources.tables import save_overwrite

__all__ = ["bucket_digests", "digest_tree", "write_digested", "differing_buckets", "digested_change_feed"]

BUCKETS = 256
FANOUT = 64
BUCKET = "digest_bucket"


def _row_hash(cols: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in sorted(cols) for x in (F.col(c).isNull(), F.col(c))])


def _digest(first: Column, second: Column) -> list[Column]:
    """Digests of a group of hashed rows; the sum is of 40 bits, which no group overflows."""
    return [F.bit_xor(first).alias("mixed"), F.sum(F.pmod(second, F.lit(1 << 40))).alias("total")]


def bucket_digests(df: DataFrame, bucket_col: str = BUCKET) -> DataFrame:
    """(node, n, mixed, total) per bucket: one pre-aggregated pass."""
    cols = [c for c in df.columns if c != bucket_col]
    return (df.groupBy(F.col(bucket_col).cast("long").alias("node"))
            .agg(F.count(F.lit(1)).alias("n"), *_digest(_row_hash(cols, 1), _row_hash(cols, 2))))


def digest_tree(leaves: DataFrame, levels: int = 2, fanout: int = FANOUT) -> DataFrame:
    """(level, node, n, mixed, total): the leaves and ``levels`` levels above them."""
    below = ["node", "n", "mixed", "total"]
    out, now = leaves.select(F.lit(0).alias("level"), *below), leaves
    for level in range(1, levels + 1):
        now = (now.groupBy(F.floor(F.col("node") / fanout).alias("up"))
               .agg(F.sum("n").alias("sum_n"), *_digest(F.xxhash64(F.lit(1), *below), F.xxhash64(F.lit(2), *below)))
               .select(F.col("up").alias("node"), F.col("sum_n").alias("n"), "mixed", "total"))
        out = out.unionByName(now.select(F.lit(level).alias("level"), *below))
    return out


def write_digested(df: DataFrame, path: str, keys: Sequence[str], bucket: Column | None = None, buckets: int = BUCKETS) -> None:
    """A snapshot in bucket folders, and its digests."""
    spark = df.sparkSession
    number = bucket if bucket is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets))
    save_overwrite(df.withColumn(BUCKET, number.cast("long")), f"{path}/rows", [BUCKET])
    stored = spark.read.parquet(f"{path}/rows")
    save_overwrite(digest_tree(bucket_digests(stored)).coalesce(1), f"{path}/digests")   # a row per bucket


def differing_buckets(spark: SparkSession, old: str, new: str, fanout: int = FANOUT) -> list[int]:
    """Numbers of the buckets whose digests differ, found from the top down."""
    sides = [spark.read.parquet(f"{p}/digests") for p in (old, new)]
    top = sides[0].agg(F.max("level")).first()[0]
    if top is None:
        top = sides[1].agg(F.max("level")).first()[0] or 0
    nodes = None
    for level in range(top, -1, -1):
        a, b = (s.where(F.col("level") == level) for s in sides)
        if nodes is not None:
            up = F.floor(F.col("node") / fanout).isin(nodes)
            a, b = a.where(up), b.where(up)
        a, b = a.alias("a"), b.alias("b")
        same = (F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.mixed").eqNullSafe(F.col("b.mixed"))
                & F.col("a.total").eqNullSafe(F.col("b.total")))
        differ = (a.join(b, F.col("a.node") == F.col("b.node"), "full_outer").where(~same)
                  .select(F.coalesce("a.node", "b.node").alias("node")))
        nodes = sorted(r["node"] for r in differ.collect())
        if not nodes:
            break
    return nodes


def digested_change_feed(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """``change_feed`` of two digested snapshots."""
    nodes = differing_buckets(spark, old, new)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col(BUCKET).isin(nodes)).drop(BUCKET) for p in (old, new))
    return change_feed(a, b, keys)
