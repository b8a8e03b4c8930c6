"""Tenant onboarding: new-entity detection, id uniqueness, required fields.

The original job collected the stored ids to the driver and filtered a
Python list; here it is a ``left_anti`` join, so neither side passes through
the driver and both can be arbitrarily large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import missing_fields

__all__ = [
    "new_entities", "first_per_key", "classify_ids", "judge_feed", "reject_reasons", "active_entities",
    "master_rows", "soft_delete",
]

# --- fixed values of the original onboarding job ---
ONBOARDING_STATUS = "ACTIVE"
REQUIRED_FIELDS = ("customer_id", "customer_name", "schema_name", "cloud_provider", "data_path")
# --- end of fixed values ---


def new_entities(feed: DataFrame, stored: DataFrame, key: str = "customer_id") -> DataFrame:
    """Feed rows whose key is not stored yet."""
    return feed.join(stored.select(key), key, "left_anti")


def first_per_key(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """First row per key by ``order_cols`` (grouped ``min_by``: skew-safe)."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("__r"))
    return agg.select(key, *[F.col(f"__r.{c}").alias(c) for c in cols])


def classify_ids(feed: DataFrame, stored: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """Label every feed row ``ok`` / ``duplicate`` (not the first of its key in
    this batch) / ``exists`` (key already stored) -- the 409 rule, in bulk."""
    order_cols = list(order_cols)
    keeper = first_per_key(feed.select(key, *order_cols), key, order_cols)
    keeper = keeper.select(key, F.struct(*order_cols).alias("__keep"))
    known = stored.select(key).distinct().withColumn("__known", F.lit(True))
    j = feed.join(keeper, key, "left").join(known, key, "left")
    status = (F.when(F.col("__known"), F.lit("exists"))
              .when(F.struct(*order_cols) == F.col("__keep"), F.lit("ok"))
              .otherwise(F.lit("duplicate")))
    return j.select(*feed.columns, status.alias("status"))


def judge_feed(feed: DataFrame, stored: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """Every feed row with its ``reason`` to be rejected, null for the rows that
    enter: of the valid rows of an id the first by ``order_cols``, unless the id
    is stored.  Validity is judged row by row, so an invalid row neither enters
    nor hides a valid one of the same id.  ``feed`` must not change between reads."""
    missing = missing_fields(list(REQUIRED_FIELDS))
    lacking = feed.where(missing.isNotNull()).withColumn("reason", F.concat(F.lit("Missing field: "), missing))
    status = classify_ids(feed.where(missing.isNull()), stored, key, list(order_cols))
    reason = (F.when(F.col("status") == "exists", F.lit("Existing id")).when(F.col("status") == "duplicate", F.lit("Duplicate id")))
    return status.withColumn("reason", reason).drop("status").unionByName(lacking)


def reject_reasons(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS,
                   key: str = "customer_id") -> DataFrame:
    """Valid / rejected split with the names of missing required fields."""
    miss = missing_fields(list(required))
    return df.select(key, miss.isNull().alias("valid"),
                     F.when(miss.isNotNull(), F.concat(F.lit("Missing field: "), miss)).alias("reason"))


def active_entities(df: DataFrame, cols: Sequence[str] = ("customer_id", "schema_name"),
                    flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag)).select(*cols)


def master_rows(new: DataFrame, *, created_by: str = "feed_onboarding",
                as_of: Column | None = None, with_stamps: bool = False) -> DataFrame:
    """Shape new feed rows into the tenant master table: default ``is_active``
    to true, status ACTIVE, no pipeline run yet."""
    cols = [
        F.col("customer_id").cast("string").alias("customer_id"),
        "customer_name", "schema_name", "cloud_provider", "data_path",
        F.coalesce(F.col("is_active").cast("boolean"), F.lit(True)).alias("is_active"),
        F.lit(ONBOARDING_STATUS).alias("onboarding_status"),
        F.lit(None).cast("timestamp").alias("last_pipeline_run"),
        F.lit(created_by).alias("created_by"),
    ]
    if with_stamps:
        ts = as_of if as_of is not None else F.current_timestamp()
        cols += [ts.alias("created_at"), ts.alias("updated_at")]
    return new.select(*cols)


def soft_delete(master: DataFrame, delete_ids: DataFrame, key: str = "customer_id",
                flag: str = "is_active") -> tuple[DataFrame, DataFrame]:
    """Deactivate tenants: ``flag`` set to false for known ids (an upsert of one
    column; rows are kept).  Returns ``(new_master, rejected)`` -- ids that are
    not in the master table are rejected instead of silently "succeeding"."""
    ids = delete_ids.select(key).distinct()
    hit = ids.join(master.select(key), key, "left_semi").withColumn("__del", F.lit(True))
    new = master.join(hit, key, "left").select(
        *[F.when(F.col("__del"), F.lit(False)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
          for c in master.columns])
    rejected = ids.join(master.select(key), key, "left_anti").withColumn("reason", F.lit("unknown id"))
    return new, rejected
