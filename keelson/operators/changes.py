"""Change feed between two snapshots and a snapshot manifest (table versions).

Without a transactional table format, a table "version" is a snapshot: the
manifest table ``(table_name, version, path, n_rows, committed_at)`` is
appended *after* the snapshot data is written, so readers never see a
half-written version.  The change feed of two snapshots is a full outer join
on the keys with a null-safe comparison of the value columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["change_feed", "apply_changes", "latest_version", "manifest_entry"]


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows tagged ``insert``, ``delete``, ``update_preimage``, ``update_postimage``."""
    keys = list(keys)
    vals = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*vals).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*keys, F.struct(*vals).alias("__new"), F.lit(True).alias("__in_new"))
    j = o.join(n, keys, "full_outer")
    kind = (F.when(F.col("__in_old").isNull(), F.lit("insert"))
            .when(F.col("__in_new").isNull(), F.lit("delete"))
            .when(~F.col("__old").eqNullSafe(F.col("__new")), F.lit("update")))
    j = j.withColumn("__kind", kind).where(F.col("__kind").isNotNull())
    entries = (F.when(F.col("__kind") == "insert",
                      F.array(F.struct(F.lit("insert").alias("t"), F.col("__new").alias("v"))))
               .when(F.col("__kind") == "delete",
                     F.array(F.struct(F.lit("delete").alias("t"), F.col("__old").alias("v"))))
               .otherwise(F.array(F.struct(F.lit("update_preimage").alias("t"), F.col("__old").alias("v")),
                                  F.struct(F.lit("update_postimage").alias("t"), F.col("__new").alias("v")))))
    e = j.select(*keys, F.explode(entries).alias("__e"))
    return e.select(*keys, F.col("__e.t").alias("change_type"), *[F.col(f"__e.v.{c}").alias(c) for c in vals])


def apply_changes(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old + change feed -> new (used to check the feed is complete)."""
    keys = list(keys)
    vals = [c for c in old.columns if c not in keys]
    touched = changes.select(*keys).distinct()
    kept = old.join(touched, keys, "left_anti")
    added = changes.where(F.col("change_type").isin("insert", "update_postimage")).select(*keys, *vals)
    return kept.unionByName(added)


def manifest_entry(df: DataFrame, table_name: str, version_col: str, ts_col: str) -> DataFrame:
    """Manifest rows for a table whose snapshots are identified by ``version_col``."""
    return (df.groupBy(F.col(version_col).alias("version"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.max(ts_col).alias("committed_at"))
            .select(F.lit(table_name).alias("table_name"), "version", "n_rows", "committed_at"))


def latest_version(manifest: DataFrame) -> DataFrame:
    """Latest committed version per table (numeric max, not lexical)."""
    v = F.col("version").cast("long")
    return manifest.groupBy("table_name").agg(
        F.max(v).alias("version"),
        F.max_by("n_rows", v).alias("n_rows"),
        F.max_by("committed_at", v).alias("committed_at"),
        F.count(F.lit(1)).alias("n_versions"))
