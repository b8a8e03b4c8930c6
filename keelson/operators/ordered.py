"""Running totals in a global (or per-group) order without a one-task window.

``sum(x) OVER (ORDER BY v)`` with no PARTITION BY runs in a single task; a
per-group window puts a hot group in one task.  Instead:

1. range-partition the rows on (group, order key) and land them, each with the
   number of its range.  Spark samples the whole key, so long shared
   prefixes, outliers and hot groups still spread; the number of ranges follows
   the number of rows;
2. running sum inside each (range, group) -- a window over a bounded slice;
3. totals per (range, group) -> prefix over the ranges -> offsets;
4. offset + in-range running sum.

The landed table fixes the ranges, so steps 2 and 3 agree even if a stage is
recomputed after an executor loss.  Callers aggregate to distinct order keys
first, so a hot *value* is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import scratch_path

__all__ = ["running_totals", "ROWS_PER_RANGE"]

ROWS_PER_RANGE = 250_000


def running_totals(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                   group_cols: Sequence[str] = (), *, buckets: int | None = None, prefix: str = "cum_",
                   keep_bucket: bool = False, stored: bool = False) -> DataFrame:
    """Adds ``prefix + c`` = inclusive running sum of ``c`` for each ``sum_cols``.

    ``order_cols`` must order rows totally within a group (ties would be
    summed in an arbitrary order).  A null group key is a group of its own.
    ``buckets`` asks for so many ranges in the largest group; by default a
    range holds about ROWS_PER_RANGE rows.  ``df`` is read three times (to count,
    to sample and to deal out), so it is landed first unless it is ``stored``."""
    order_cols, sum_cols, group_cols = list(order_cols), list(sum_cols), list(group_cols)
    spark = df.sparkSession
    path = scratch_path(spark, "running_totals")
    # one non-null column names the group, so joins on it keep null keys
    name = (F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}) if group_cols else F.lit(""))
    rows = df.withColumn("__group", name)
    if not stored:
        rows.write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
    if buckets is None:
        ranges = math.ceil(rows.count() / ROWS_PER_RANGE)
    else:
        size = rows.groupBy("__group").count().agg(F.sum("count").alias("all"), F.max("count").alias("top")).first()
        ranges = math.ceil(buckets * (size["all"] or 0) / (size["top"] or 1))
    (rows.repartitionByRange(max(1, ranges), "__group", *order_cols)
     .withColumn("__bucket", F.spark_partition_id()).write.parquet(f"{path}/ranges"))
    landed = spark.read.parquet(f"{path}/ranges")

    w_in = (Window.partitionBy("__bucket", "__group").orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = landed.select("*", *[F.sum(c).over(w_in).alias(f"__loc_{c}") for c in sum_cols])
    totals = landed.groupBy("__bucket", "__group").agg(*[F.sum(c).alias(f"__tot_{c}") for c in sum_cols])
    # at most one row per range and group
    w_off = (Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__bucket", "__group",
                            *[F.coalesce(F.sum(f"__tot_{c}").over(w_off), F.lit(0)).alias(f"__off_{c}")
                              for c in sum_cols])
    out = local.join(offsets, ["__bucket", "__group"], "inner")
    return out.select(*df.columns, *(["__bucket"] if keep_bucket else []),
                      *[(F.col(f"__off_{c}") + F.col(f"__loc_{c}")).alias(prefix + c) for c in sum_cols])
