"""Category -> integer code maps (fit / apply) and feature assembly.

Codes follow the *sorted* order of the distinct non-null categories seen at
fit time (0..k-1); unseen or null values map to -1 at apply time.  Spark ML's
``StringIndexer`` gives unseen values k, hence a map table + join instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordered import running_totals
from keelson.session import landed

__all__ = ["fit_category_map", "apply_category_map", "encode_categories", "assemble"]

UNSEEN = -1


def fit_category_map(df: DataFrame, col: str) -> DataFrame:
    """``(col, code)`` for each distinct non-null value, codes in sorted order.

    Distinct values are numbered with a distributed running count, not a
    global ``row_number()`` window, so a high-cardinality column is fine."""
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("__one", F.lit(1))
    numbered = running_totals(distinct, [col], ["__one"])
    return landed(numbered.select(col, (F.col("cum___one") - 1).cast("int").alias("code")), "category_map")


def apply_category_map(df: DataFrame, col: str, mapping: DataFrame, out_col: str | None = None) -> DataFrame:
    """Left join to the fitted map; unseen / null -> -1.  A fitted map is a
    landed table: its measured size decides between a broadcast and a
    sort-merge join."""
    out_col = out_col or f"{col}_code"
    m = mapping.select(F.col(col).alias("__cat"), F.col("code").alias("__code"))
    j = df.join(m, df[col] == m["__cat"], "left")
    return j.select(*df.columns, F.coalesce(F.col("__code"), F.lit(UNSEEN)).alias(out_col))


def encode_categories(train: DataFrame, frames: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Fit one map per column on ``train``; apply to every frame (codes in place)."""
    maps = {c: fit_category_map(train, c) for c in cols}
    out = []
    for f in frames:
        for c in cols:
            f = apply_category_map(f, c, maps[c], out_col=f"__{c}_code").drop(c) \
                .withColumnRenamed(f"__{c}_code", c)
        out.append(f)
    return out


def assemble(df: DataFrame, feature_cols: Sequence[str], out_col: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out_col,
                           handleInvalid="keep").transform(df)
