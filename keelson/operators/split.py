"""Seeded, disjoint and exhaustive train/test split.

``randomSplit`` draws per partition, so the same row can change side when
the input is repartitioned or a task is retried.  Here the side is a pure
function of (id, seed): md5 -> 32-bit value -> bucket in [0, 10000) -> test if
bucket < fraction * 10000.  No shuffle, no action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import hash_bucket
from keelson.operators.ordered import running_totals

__all__ = ["assign_split", "split_frames", "assign_split_exact"]

BUCKETS = 10000


def assign_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42,
                 label_col: str = "split", keep_bucket: bool = False) -> DataFrame:
    bucket = hash_bucket(F.col(id_col), seed, BUCKETS)
    threshold = int(round(test_fraction * BUCKETS))
    out = df.withColumn("__bucket", bucket).withColumn(
        label_col, F.when(F.col("__bucket") < threshold, F.lit("test")).otherwise(F.lit("train")))
    return out.withColumnRenamed("__bucket", "bucket") if keep_bucket else out.drop("__bucket")


def split_frames(df: DataFrame, id_col: str, test_fraction: float = 0.2,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, id_col, test_fraction, seed)
    return (s.where(F.col("split") == "train").drop("split"),
            s.where(F.col("split") == "test").drop("split"))


def assign_split_exact(df: DataFrame, id_col: str, n_test: Column | int | None = None, seed: int = 42,
                       label_col: str = "split", test_fraction: float = 0.2) -> DataFrame:
    """Exactly ``n_test`` rows in test (default ceil(test_fraction * n), the
    size a shuffled train/test split gives): rank rows by (md5, id) with a
    distributed running count and cut there.  n is a scalar subquery."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))
    ranked = running_totals(df.withColumn("__h", h).withColumn("__one", F.lit(1)),
                            ["__h", id_col], ["__one"])
    if n_test is None:
        n_test = F.ceil(df.select(F.count(F.lit(1))).scalar() * F.lit(test_fraction))
    n = F.lit(n_test) if isinstance(n_test, int) else n_test
    return ranked.withColumn(label_col, F.when(F.col("cum___one") <= n, F.lit("test"))
                             .otherwise(F.lit("train"))).drop("__h", "__one", "cum___one")
