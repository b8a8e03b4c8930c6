"""Synthetic rows that follow the column distributions of a source table.

* numeric  -> Normal(mean, sample std) by Box-Muller on md5 uniforms,
  optionally floored (physical attributes cannot be negative);
* category -> drawn by observed frequency (inverse CDF);
* timestamp -> uniform between min and max;
* drift injection: scale numerics, force a category mix.

Randomness is a pure function of (row key, seed, column), so regenerating a
lost partition reproduces it exactly.  By default one synthetic row is made
per source row (keyed by the source key), so the work grows with the table.
Profiles are one-row aggregates used as scalar subqueries; the category
inverse-CDF is an equi-join on a coarse bucket of the uniform, never a range
or cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import std_normal, uniform01
from keelson.operators.ordered import running_totals
from keelson.session import landed

__all__ = ["synthesize_numeric", "synthesize_category", "synthesize_timestamp", "synthesize_table", "inject_drift",
           "synthetic_ids", "synthetic_keys", "DEFAULT_ROWS", "DEFAULT_TEST_ROWS"]

# --- fixed values of the original generator ---
PHYSICAL_FLOOR = 0.1
DRIFT_SCALE = 1.5
DRIFT_MIX = (0.7, 0.3)
DEFAULT_ROWS = 500
DEFAULT_TEST_ROWS = 100
# --- end of fixed values ---

_MIN_GRID = 1024


def synthetic_ids(key: Column, id_base: int) -> Column:
    """Fresh string ids: base (epoch ms in the original) + running index."""
    return (F.lit(id_base) + key.cast("bigint")).cast("string")


def synthesize_numeric(source: DataFrame, key_col: str, col: str, *, seed: int = 42,
                       floor: float | None = None, decimals: int | None = 6) -> Column:
    """Column expression (over a frame holding ``key_col``) drawing
    Normal(mean(col), std(col)); mean / std are scalar subqueries on ``source``."""
    mean = source.select(F.avg(col)).scalar()
    std = source.select(F.stddev_samp(col)).scalar()
    x = mean + std * std_normal(F.col(key_col), seed)
    x = x if floor is None else F.greatest(F.lit(floor), x)
    return F.round(x, decimals) if decimals is not None else x


def synthesize_category(source: DataFrame, keys: DataFrame, key_col: str, col: str, *,
                        salt: str = "#cat", out_col: str | None = None) -> DataFrame:
    """Adds ``out_col`` drawn from the frequency distribution of ``col``.

    Categories in sorted order own consecutive intervals [lo, hi) of [0, 1).
    Each interval is listed under every grid cell it touches; the grid has at
    least as many cells as categories, so at most 2 x cells rows are listed and
    a row meets a few of them however many categories there are.  The list is
    landed, so its measured size picks the join; rows look up their cell by
    equality and keep the interval that contains their uniform."""
    out_col = out_col or col
    counts = source.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    counts = landed(counts, "category_counts")
    size = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()
    grid, total = max(_MIN_GRID, size["k"]), F.lit(size["n"])
    cum = running_totals(counts, [col], ["__n"])
    iv = cum.select(F.col(col).alias("__cat"), ((F.col("cum___n") - F.col("__n")) / total).alias("__lo"),
                    (F.col("cum___n") / total).alias("__hi"))
    cells = iv.withColumn("__cell", F.explode(F.sequence(
        F.floor(F.col("__lo") * grid).cast("int"),
        F.least(F.ceil(F.col("__hi") * grid).cast("int") - 1, F.lit(grid - 1)))))
    cells = landed(cells, "category_cells")
    u = uniform01(F.col(key_col), salt)
    k = keys.withColumn("__u", u).withColumn("__cell", F.floor(F.col("__u") * grid).cast("int"))
    j = k.join(cells, "__cell", "inner").where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi")))
    return j.select(*[c for c in keys.columns if c != out_col], F.col("__cat").alias(out_col))


def synthesize_timestamp(source: DataFrame, key_col: str, col: str, *, salt: str = "#ts") -> Column:
    lo = source.select(F.unix_micros(F.min(F.col(col).cast("timestamp")))).scalar()
    hi = source.select(F.unix_micros(F.max(F.col(col).cast("timestamp")))).scalar()
    span = hi - lo
    micros = lo + F.floor(uniform01(F.col(key_col), salt) * span).cast("bigint")
    return F.when(span > 0, F.timestamp_micros(micros)).otherwise(F.timestamp_micros(lo))


def synthesize_table(source: DataFrame, keys: DataFrame, key_col: str, *, numeric: Sequence[str] = (),
                     categories: Sequence[str] = (), timestamps: Sequence[str] = (), others: Sequence[str] = (),
                     id_base: int = 0, seed: int = 42, floor: float | None = PHYSICAL_FLOOR, decimals: int | None = 6,
                     drift: bool = False, drift_category: str | None = None,
                     drift_values: Sequence[str] = ()) -> DataFrame:
    """One synthetic row per key over all columns: numerics normal around the
    source's mean and deviation, categories by frequency, timestamps uniform
    over their range, any other column by the frequency of its values.  With
    ``drift`` the numerics are scaled and ``drift_category`` is redrawn."""
    out = keys.select(key_col, synthetic_ids(F.col(key_col), id_base).alias("Id"))
    out = out.withColumns({c: synthesize_numeric(source, key_col, c, seed=seed + i, floor=floor, decimals=decimals)
                           for i, c in enumerate(numeric)})
    out = out.withColumns({c: synthesize_timestamp(source, key_col, c, salt=f"#{c}") for c in timestamps})
    for c in [*categories, *others]:
        out = synthesize_category(source, out, key_col, c, salt=f"#{c}")
    if drift:
        out = inject_drift(out, key_col, list(numeric), drift_category, drift_values,
                           decimals=None if decimals is None else decimals + 1)   # a scaled value is no tie
    return out.drop(key_col)


def inject_drift(df: DataFrame, key_col: str, numeric_cols: Sequence[str], category_col: str | None,
                 categories: Sequence[str] = (), *, scale: float = DRIFT_SCALE,
                 mix: Sequence[float] = DRIFT_MIX, salt: str = "#drift", decimals: int | None = 6) -> DataFrame:
    out = df
    for c in numeric_cols:
        v = F.col(c) * F.lit(scale)
        out = out.withColumn(c, F.round(v, decimals) if decimals is not None else v)
    if category_col and categories:
        u = uniform01(F.col(key_col), salt)
        edge, expr = 0.0, None
        for cat, p in zip(categories, mix):
            edge += p
            expr = F.when(u < F.lit(edge), F.lit(cat)) if expr is None else expr.when(u < F.lit(edge), F.lit(cat))
        out = out.withColumn(category_col, expr.otherwise(F.lit(categories[-1])))
    return out


def synthetic_keys(spark, num_rows: int = DEFAULT_ROWS, key_col: str = "k") -> DataFrame:
    """Keys for a fixed number of synthetic rows (the original's ``num_rows``;
    500 for training data, 100 for test data).  ``spark.range`` is generated
    on the executors, nothing is built on the driver."""
    return spark.range(num_rows).withColumnRenamed("id", key_col)
