"""Sources, sinks and table operations.

Reads: parquet tables, CSV with header (explicit schema, no inference), a
JSON feed landed as files.  Writes: overwrite with a load stamp, append,
one-row inserts, append-only state tables read latest-wins, snapshot folders
committed through a manifest, and DDL for schemas / layered tables.

Parquet tables cannot be updated in place (``UPDATE`` is rejected), so
"update" is always "append a newer row" and readers take the latest.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "read_table", "table_exists", "scan_csv", "read_json_feed", "stamp", "save_overwrite", "save_split", "append",
    "insert_row", "ensure_schema", "ensure_table", "provision_layers", "control_set", "control_get",
    "ensure_control_tables", "request_approvals", "active_tenants",
    "require_columns", "write_snapshot", "latest_snapshot", "snapshot_manifest", "log_run", "log_runs",
    "record_inputs", "schema_json", "check_signature", "LAYER_DDL", "TENANT_BUCKETS", "tenant_bucket",
    "tenant_rows",
]


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """Catalog table name, or a parquet path."""
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def table_exists(spark: SparkSession, name_or_path: str) -> bool:
    """Is there such a table, or such a parquet path with data?  Any other
    reason that a read fails is raised."""
    if not ("/" in name_or_path or name_or_path.endswith(".parquet")):
        return spark.catalog.tableExists(name_or_path)
    try:
        spark.read.parquet(name_or_path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True,
             mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with a header row.  The schema is given (inference would scan the
    whole input twice and guess types per file)."""
    return (spark.read.schema(schema).option("header", header).option("mode", mode)
            .option("enforceSchema", False).csv(path))


def read_json_feed(spark: SparkSession, path: str, schema: T.StructType | str,
                   multiline: bool = False) -> DataFrame:
    """API payloads landed as JSON files (one record per line, or JSON arrays
    with ``multiline``).  Fetching them over HTTP is outside Spark."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def stamp(df: DataFrame, col: str = "update_timestamp_utc", as_of: Column | None = None) -> DataFrame:
    """Add a load stamp; ``current_timestamp()`` is already UTC, so the
    original ``to_utc_timestamp(now, 'UTC')`` is the identity."""
    return df.withColumn(col, as_of if as_of is not None else F.current_timestamp())


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str]):
    """Partitioned writes first REBALANCE on the partition columns: each
    partition value lands in few files instead of one file per task, and AQE
    splits a hot value (a tenant with a third of the rows) over several
    advisory-size tasks instead of one."""
    if partition_by:
        return df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    return df.write.mode(mode)


def save_overwrite(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    w = _writer(df, "overwrite", partition_by)
    w.saveAsTable(table) if "/" not in table else w.parquet(table)


def append(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    w = _writer(df, "append", partition_by)
    w.saveAsTable(table) if "/" not in table else w.parquet(table)


def save_split(train: DataFrame, test: DataFrame, train_table: str, test_table: str,
               as_of: Column | None = None) -> None:
    """Overwrite train / test tables, each with the load stamp."""
    save_overwrite(stamp(train, as_of=as_of), train_table)
    save_overwrite(stamp(test, as_of=as_of), test_table)


def insert_row(spark: SparkSession, table: str, values: Sequence, schema: T.StructType | str) -> None:
    """``INSERT INTO t VALUES (...)`` without string-built SQL: a one-row frame."""
    append(spark.createDataFrame([tuple(values)], schema), table)


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the schema once; ``location`` is its folder (by default the warehouse's)."""
    where = " LOCATION '{}'".format(location.replace("'", "\\'")) if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")


def ensure_table(spark: SparkSession, name: str, columns_ddl: str, *, using: str = "PARQUET",
                 partitioned_by: Sequence[str] = ()) -> None:
    part = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns_ddl}) USING {using}{part}")


# --- fixed values: column lists as in the original DDL, plus the tenant key and
# its hash bucket, so all tenants share one table per layer ---
LAYER_DDL = {
    "bronze_raw": "source_file STRING, raw_payload STRING, ingest_ts TIMESTAMP, customer_id STRING, "
                  "tenant_bucket INT",
    "silver_clean": "record_id STRING, clean_payload STRING, process_ts TIMESTAMP, customer_id STRING, "
                    "tenant_bucket INT",
    "gold_features": "record_id STRING, feature_1 DOUBLE, feature_2 DOUBLE, label INT, train_ts TIMESTAMP, customer_id STRING, "
                     "tenant_bucket INT",
}
# --- end of fixed values ---
TENANT_BUCKETS = 64


def tenant_bucket(col: str | Column, buckets: int = TENANT_BUCKETS) -> Column:
    """Stable hash bucket of a tenant id (the partition column of the layers).
    The layers always use TENANT_BUCKETS, so a reader cannot prune by another
    count than the writer's."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def tenant_rows(df: DataFrame, tenant_id: str, key: str = "customer_id") -> DataFrame:
    """One tenant's rows: the bucket predicate prunes to one partition folder,
    the key predicate skips row groups (files are sorted by tenant)."""
    return df.where((F.col("tenant_bucket") == tenant_bucket(F.lit(tenant_id)))
                    & (F.col(key) == tenant_id))


def provision_layers(spark: SparkSession, database: str, location: str | None = None) -> list[str]:
    """One table per layer for all tenants, partitioned by a bounded hash
    bucket of the tenant id: adding a tenant needs no DDL (the original
    created a schema + 3 tables per tenant in a driver loop), and thousands of
    small tenants do not turn into thousands of tiny folders.  Idempotent."""
    ensure_schema(spark, database, location)
    names = []
    for table, ddl in LAYER_DDL.items():
        name = f"{database}.{table}"
        ensure_table(spark, name, ddl, partitioned_by=["tenant_bucket"])
        names.append(name)
    return names


def active_tenants(customers: DataFrame) -> DataFrame:
    """(customer_id, schema_name) of the tenants that are provisioned: null flags
    are not active."""
    return customers.where(F.col("is_active")).select("customer_id", "schema_name")


def control_set(spark: SparkSession, table: str, allow: bool, as_of: Column | None = None) -> None:
    """Set the training flag: append a new state row (latest wins on read)."""
    df = spark.range(1).select(F.lit(bool(allow)).alias("allow_training"),
                               (as_of if as_of is not None else F.current_timestamp()).alias("updated_on"))
    append(df, table)


def control_get(spark: SparkSession, table: str) -> DataFrame:
    """Latest control row, as a one-row frame (``max_by``, no sort)."""
    t = read_table(spark, table)
    return t.agg(F.max_by("allow_training", "updated_on").alias("allow_training"),
                 F.max("updated_on").alias("updated_on"))


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail fast at analysis time when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


# ---------------------------------------------------------------- snapshots

def write_snapshot(spark: SparkSession, df: DataFrame, table_dir: str, version: int,
                   as_of: Column | None = None) -> None:
    """Write ``<dir>/v=<version>`` then append its manifest row.  Readers only
    see versions listed in the manifest, so a half-written snapshot is
    invisible, and rewriting the same version (a retry) is idempotent."""
    path = os.path.join(table_dir, f"v={version}")
    df.write.mode("overwrite").parquet(path)
    n = spark.read.parquet(path).count()
    row = spark.range(1).select(F.lit(int(version)).cast("long").alias("version"),
                                F.lit(path).alias("path"), F.lit(n).cast("long").alias("n_rows"),
                                (as_of if as_of is not None else F.current_timestamp()).alias("committed_at"))
    row.write.mode("append").parquet(os.path.join(table_dir, "_manifest"))


def snapshot_manifest(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The manifest, or None before the first commit; other errors rise."""
    path = os.path.join(table_dir, "_manifest")
    return spark.read.parquet(path) if table_exists(spark, path) else None


def latest_snapshot(spark: SparkSession, table_dir: str, before: int | None = None) -> DataFrame | None:
    """Newest committed snapshot (optionally the newest older than ``before``).
    A state kept as deltas is folded to its newest rows."""
    if table_exists(spark, os.path.join(table_dir, "_about")):
        from keelson.sources.deltas import DeltaLog
        return DeltaLog.open(spark, table_dir).latest(before)
    man = snapshot_manifest(spark, table_dir)
    if man is None:
        return None
    if before is not None:
        man = man.where(F.col("version") < before)
    latest = man.agg(F.max("version")).first()[0]
    if latest is None:
        return None
    return spark.read.parquet(os.path.join(table_dir, f"v={latest}"))


# ---------------------------------------------------------------- run registry

RUNS_SCHEMA = ("run_id STRING, start_time TIMESTAMP, params MAP<STRING, STRING>, "
               "metrics MAP<STRING, STRING>, tags MAP<STRING, STRING>")


VERSIONS_SCHEMA = "model_name STRING, version STRING, run_id STRING, schema_json STRING, created_at TIMESTAMP"
ALIASES_SCHEMA = "model_name STRING, alias STRING, version STRING, updated_at TIMESTAMP"
INPUTS_SCHEMA = "run_id STRING, table_name STRING, version STRING, context STRING"
# --- fixed values: column lists of the original control and approval tables ---
CONTROL_SCHEMA = "allow_training BOOLEAN, updated_on TIMESTAMP"
APPROVALS_SCHEMA = "run_id STRING, model_name STRING, model_version STRING, status STRING, requested_on TIMESTAMP"
# --- end of fixed values ---


def ensure_control_tables(spark: SparkSession, database: str) -> list[str]:
    """The training-control and approval-request tables, created once."""
    ensure_schema(spark, database)
    names = []
    for table, ddl in (("training_control", CONTROL_SCHEMA), ("model_approvals", APPROVALS_SCHEMA)):
        ensure_table(spark, f"{database}.{table}", ddl)
        names.append(f"{database}.{table}")
    return names


def request_approvals(spark: SparkSession, table: str, candidates: DataFrame, as_of: Column | None = None) -> None:
    """A PENDING row per candidate (run_id, model_name, model_version) that has none yet."""
    stamp_ = as_of if as_of is not None else F.current_timestamp()
    key = ["run_id", "model_name", "model_version"]
    new = candidates.select(*[F.col(c).cast("string").alias(c) for c in key]).distinct()
    if table_exists(spark, table):
        new = new.join(read_table(spark, table).select(*key), key, "left_anti")
    append(new.select(*key, F.lit("PENDING").alias("status"), stamp_.alias("requested_on")), table)


def log_run(spark: SparkSession, table: str, run_id: str, params: Mapping[str, object],
            metrics: DataFrame | Mapping[str, float], tags: Mapping[str, str] | None = None,
            start_time: Column | None = None) -> None:
    """Append one run row.  ``metrics`` may be a one-row DataFrame of metric
    columns (computed by Spark, never collected) or a small dict."""
    def to_map(d: Mapping[str, object]) -> Column:
        if not d:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(str(v)))])

    if isinstance(metrics, DataFrame):
        names = metrics.columns
        mcol = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
        base = metrics
    else:
        mcol, base = to_map({k: v for k, v in metrics.items()}), spark.range(1)
    row = base.select(F.lit(run_id).alias("run_id"),
                      (start_time if start_time is not None else F.current_timestamp()).alias("start_time"),
                      to_map(params).alias("params"), mcol.alias("metrics"),
                      to_map(tags or {}).alias("tags"))
    append(row, table)


def log_runs(spark: SparkSession, table: str, runs: DataFrame, metric_cols: Sequence[str], params: Mapping[str, object],
             start_time: Column | None = None) -> None:
    """Append a run row per row of ``runs`` (run_id and metric columns), in one write."""
    entries = [x for m in metric_cols for x in (F.lit(m), F.col(m).cast("string"))]
    told = [x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))]
    blank = F.create_map().cast("map<string,string>")
    append(runs.select(F.col("run_id").cast("string").alias("run_id"),
                       (start_time if start_time is not None else F.current_timestamp()).alias("start_time"),
                       (F.create_map(*told) if told else blank).alias("params"), F.create_map(*entries).alias("metrics"),
                       blank.alias("tags")), table)


def record_inputs(spark: SparkSession, table: str, run_id: str,
                  inputs: Sequence[tuple[str, int | str, str]]) -> None:
    """Input lineage of a run: (table, version, context) rows."""
    rows = [(run_id, t, str(v), c) for t, v, c in inputs]
    append(spark.createDataFrame(rows, "run_id string, table_name string, version string, context string"), table)


def schema_json(df: DataFrame, cols: Sequence[str] | None = None) -> str:
    """Input signature stored with a model version."""
    s = df.select(*cols).schema if cols else df.schema
    return s.json()


def check_signature(df: DataFrame, signature: str) -> DataFrame:
    """Scoring input must carry every signed column with the signed type."""
    want = T.StructType.fromJson(json.loads(signature))
    require_columns(df, [f.name for f in want.fields])
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in want.fields if have[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"columns with a type other than signed: {', '.join(wrong)}")
    return df
