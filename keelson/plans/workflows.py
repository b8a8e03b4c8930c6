"""End-to-end jobs: the original entry points as single Spark plans.

* ``prepare_training_data`` -- raw CSV -> features -> seeded split -> stamped
  train / test tables (one plan; the only extra job is the rare-fold count,
  which Spark runs as part of the same query).
* ``refresh_monitoring``     -- payloads -> monitoring rows, fallback rule,
  one append; stage counts collected by ``observe`` during that same write
  instead of five separate count jobs.
* ``train_and_register``     -- fit, evaluate, log the run, gate against the
  deployed version, register a new version when the gate passes.
* ``deployment_decision``    -- gate -> approvals -> deployable candidates.
* ``onboard_tenants``        -- landed feed -> new tenants appended.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import (
    champion, encode, medallion, metrics, monitor, onboard, pipeline, prep, registry, split, train,
)
from keelson.session import scratch_path
from keelson.sources import tables

__all__ = ["prepare_training_data", "refresh_monitoring", "train_and_register", "ModelStore", "register_candidate",
           "deployment_decision", "onboard_tenants", "load_tenant_layers"]


def prepare_training_data(spark: SparkSession, raw: DataFrame, spec: prep.PrepSpec, train_table: str,
                          test_table: str, *, test_fraction: float = 0.2, seed: int = 42,
                          as_of: Column | None = None) -> None:
    """The features are evaluated once: landed by side, then each side is saved."""
    path = scratch_path(spark, "split")
    split.assign_split(prep.feature_prep(raw, spec), spec.id_out, test_fraction, seed).write.partitionBy("split").parquet(path)
    landed = spark.read.parquet(path)
    tr, te = (landed.where(F.col("split") == side).drop("split") for side in ("train", "test"))
    tables.save_split(tr, te, train_table, test_table, as_of)


def stored_in_span(held: DataFrame, payload: DataFrame, time_col: str = "request_time") -> DataFrame:
    """Stored records that a batch of payloads may deliver again: a record has its
    request's time, so the batch's time span, as literals, skips row groups of the
    table, which is appended in time order."""
    first, last = payload.agg(F.min(time_col), F.max(time_col)).first()
    return held.where(F.col("timestamp").isNull() | F.col("timestamp").between(F.lit(first), F.lit(last)))


def stored_in_buckets(held: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows in the tenant buckets of a batch: its bucket numbers, at most
    TENANT_BUCKETS, are literals that prune the folders read."""
    buckets = [r[0] for r in batch.select("tenant_bucket").distinct().collect()]
    return held.where(F.col("tenant_bucket").isin(buckets))


def refresh_monitoring(payload: DataFrame, request_schema: T.StructType, response_schema: T.StructType,
                       monitoring_table: str, *, model_name: str, align: str = "position",
                       passthrough: Sequence[str] = (), write: bool = True,
                       dedup_keys: Sequence[str] | None = ("request_id", "pos")) -> dict:
    """Flatten, apply the fallback rule, append once.  Returns the observed
    counts of the rows written (no extra job).

    The refresh is incremental: of the records of a payload delivered twice
    one is kept, and records already in the monitoring table are not appended
    again (the original re-appended every payload on each run).  Records with
    a null key cannot be told apart and all stay.  ``dedup_keys=None`` appends
    everything.  The streaming form (``flatten_stream``) avoids the anti-join
    by tracking processed files in its checkpoint."""
    keys = list(dedup_keys or ())
    spark = payload.sparkSession
    carried = list(passthrough) + [c for c in keys if c != "pos" and c not in passthrough]
    flat = monitor.flatten_payload(payload, request_schema, response_schema, align=align,
                                   model_name=model_name, passthrough=carried, keep_pos="pos" in keys)
    # the fallback rule looks at the whole refresh, then repeats and already-written records drop out
    kept = monitor.prediction_fallback(flat)
    if keys:
        keyed = F.lit(True)
        for c in keys:
            keyed = keyed & F.col(c).isNotNull()
        fresh = kept.where(keyed).dropDuplicates(keys)
        if tables.table_exists(spark, monitoring_table):
            held = tables.read_table(spark, monitoring_table)
            if "timestamp" in held.columns:
                held = stored_in_span(held, payload)
            fresh = fresh.join(held.select(*keys), keys, "left_anti")
        kept = fresh.select(*kept.columns).unionByName(kept.where(~keyed))
    obs = Observation("monitoring_refresh")
    observed = kept.observe(obs, F.count(F.lit(1)).alias("n_written"),
                            F.count("prediction").alias("n_with_prediction"))
    if write:
        tables.append(observed, monitoring_table)
    else:
        observed.write.format("noop").mode("overwrite").save()
    return obs.get


def train_and_register(spark: SparkSession, train_df: DataFrame, test_df: DataFrame, *,
                       feature_cols: Sequence[str], cat_cols: Sequence[str], label_col: str,
                       run_id: str, model_name: str, runs_table: str, versions_table: str,
                       aliases_table: str, params: Mapping[str, float] | None = None,
                       tie_passes: bool = True):
    """Fit -> metrics -> run log -> champion/challenger gate -> register.

    Returns (model, gate row DataFrame)."""
    enc_train, enc_test = encode.encode_categories(train_df, [train_df, test_df], cat_cols)
    cols = list(feature_cols)
    enc_train = enc_train.select(*[F.col(c).cast("double") if c in cat_cols else F.col(c)
                                   for c in enc_train.columns])
    enc_test = enc_test.select(*[F.col(c).cast("double") if c in cat_cols else F.col(c)
                                 for c in enc_test.columns])
    model = train.fit_gbt(enc_train, cols, label_col, params)
    scored = train.score_gbt(model, enc_test, cols, [label_col])
    m = metrics.classification_metrics(scored, label_col, "prediction").select(
        "accuracy", "precision", "recall", F.col("f1").alias("f1_score"))
    tables.log_run(spark, runs_table, run_id, {**train.GBT_DEFAULTS, **(params or {})}, m)
    runs = tables.read_table(spark, runs_table)
    versions = tables.read_table(spark, versions_table)
    aliases = tables.read_table(spark, aliases_table)
    cand = spark.range(1).select(F.lit(run_id).alias("candidate_run_id"), F.lit(model_name).alias("model_name"))
    gate = registry.gate_improved(cand, runs, versions, aliases, tie_passes=tie_passes)
    new = (gate.where("improved")
           .join(runs.select(F.col("run_id").alias("candidate_run_id"), "start_time"), "candidate_run_id")
           .select(F.col("candidate_run_id").alias("run_id"), "start_time", "model_name"))
    # landed before the tables it was judged by grow; the gate row is a result, so it is fixed too
    gate = gate.checkpoint(eager=True)
    reg = registry.register_versions(versions, new).checkpoint(eager=True)
    tables.append(reg.select("model_name", F.col("version").cast("string").alias("version"), "run_id",
                             F.current_timestamp().alias("created_at")), versions_table)
    tables.append(reg.where("is_latest").select("model_name", F.lit(registry.DEFAULT_ALIAS).alias("alias"),
                                                F.col("version").cast("string").alias("version"),
                                                F.current_timestamp().alias("updated_at")), aliases_table)
    return model, gate


@dataclass(frozen=True)
class ModelStore:
    """Where runs, versions, aliases, input lineage, the control flag and the
    models themselves are kept."""

    runs: str
    versions: str
    aliases: str
    inputs: str
    control: str
    models: str

    @classmethod
    def at(cls, root: str) -> ModelStore:
        return cls(*(f"{root}/{name}" for name in ("model_runs", "model_versions", "model_aliases", "run_inputs", "training_control", "models")))

    def create(self, spark: SparkSession) -> None:
        """The tables, empty, where they don't exist yet."""
        for name, schema in ((self.runs, tables.RUNS_SCHEMA), (self.versions, tables.VERSIONS_SCHEMA),
                             (self.aliases, tables.ALIASES_SCHEMA), (self.inputs, tables.INPUTS_SCHEMA), (self.control, tables.CONTROL_SCHEMA)):
            if not tables.table_exists(spark, name):
                tables.append(spark.createDataFrame([], schema), name)


def register_candidate(spark: SparkSession, store: ModelStore, model: PipelineModel, evaluation: DataFrame, *, run_id: str,
                       model_name: str, id_col: str, label_col: str, input_cols: Sequence[str],
                       params: Mapping[str, object] | None = None, inputs: Sequence[tuple[str, int | str, str]] = (),
                       as_of: Column | None = None) -> DataFrame | None:
    """A fitted pipeline through the registration job: run and input lineage are
    logged, the champion is scored on the same rows, and a candidate that holds up
    is stored with its signature, versioned and put behind the alias.

    Returns the gate row, or None (nothing done) while the control flag forbids
    training; without a control row training is allowed.  The model is stored before
    its version and alias are, so an alias never names a missing model."""
    store.create(spark)
    allowed = tables.control_get(spark, store.control).first()["allow_training"]
    if allowed is False:
        return None
    stamp = as_of if as_of is not None else F.current_timestamp()
    path = scratch_path(spark, "candidate")
    evaluation.select(*dict.fromkeys([id_col, label_col, *input_cols])).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    gate = champion.gate_rescored(spark, model, rows, models_dir=store.models, model_name=model_name,
                                  aliases=tables.read_table(spark, store.aliases), id_col=id_col, label_col=label_col,
                                  input_cols=input_cols)
    gate.write.parquet(f"{path}/gate")
    gate = spark.read.parquet(f"{path}/gate")
    scored = model.transform(rows).withColumn("prediction", F.col("prediction").cast("int"))
    m = metrics.classification_metrics(scored, label_col, "prediction", decimals=None).select(
        "accuracy", "precision", "recall", F.col("f1").alias("f1_score"))
    tables.log_run(spark, store.runs, run_id, params or {}, m, start_time=stamp)
    if inputs:
        tables.record_inputs(spark, store.inputs, run_id, inputs)
    if gate.first()["improved"]:
        new = spark.range(1).select(F.lit(run_id).alias("run_id"), stamp.alias("start_time"), F.lit(model_name).alias("model_name"))
        held = tables.read_table(spark, store.versions)
        numbered = registry.register_versions(held, new).first()
        if numbered is not None:                          # a run is registered once
            version = str(numbered["version"])
            pipeline.save_model(model, champion.model_path(store.models, model_name, version), rows, input_cols)
            row = spark.range(1).select(F.lit(model_name).alias("model_name"), F.lit(version).alias("version"), F.lit(run_id).alias("run_id"),
                                        F.lit(tables.schema_json(rows, list(input_cols))).alias("schema_json"), stamp.alias("created_at"))
            tables.append(row, store.versions)
            tables.append(row.select("model_name", F.lit(registry.DEFAULT_ALIAS).alias("alias"), "version",
                                     F.col("created_at").alias("updated_at")), store.aliases)
    return gate


def deployment_decision(candidates: DataFrame, runs: DataFrame, versions: DataFrame, aliases: DataFrame,
                        ledger: DataFrame, **gate_kw) -> DataFrame:
    g = registry.gate_decision(candidates, runs, versions, aliases, **gate_kw)
    req = candidates.select(F.col("candidate_run_id").alias("run_id"))
    appr = registry.resolve_approvals(req, ledger)
    return registry.deployable(g, appr)


def onboard_tenants(spark: SparkSession, feed: DataFrame, master_table: str, *,
                    key: str = "customer_id", order_cols: Sequence[str] | None = None,
                    as_of: Column | None = None) -> DataFrame:
    """New tenants appended to the master table: of the valid rows of an id the
    first by ``order_cols`` (by default the order of arrival: the feed's file
    order), unless the id is stored.  Validity is judged row by row, so an
    invalid row neither enters nor hides a valid one of the same id.

    Returns the rejected feed rows (key, reason): missing fields, repeats in
    the feed, ids already stored."""
    stored = tables.read_table(spark, master_table).select(key)
    order = list(order_cols or ["__arrival"])
    rows = feed if order_cols else feed.withColumn("__arrival", F.monotonically_increasing_id())
    # one landing fixes the arrival order and the verdicts before the table grows
    path = scratch_path(spark, "onboarding")
    rows.write.parquet(f"{path}/feed")
    onboard.judge_feed(spark.read.parquet(f"{path}/feed"), stored, key, order).write.parquet(f"{path}/judged")
    judged = spark.read.parquet(f"{path}/judged")
    new = judged.where("reason is null").drop("reason", "__arrival")
    tables.append(onboard.master_rows(new, as_of=as_of, with_stamps=True), master_table)
    return judged.where("reason is not null").select(key, "reason")


def load_tenant_layers(raw: DataFrame, schema: T.StructType, features: Mapping[str, Column],
                       bronze_table: str, silver_table: str, gold_table: str, *,
                       tenant_col: str = "customer_id", as_of: Column | None = None) -> None:
    """One batch of landed lines of all tenants -> bronze -> silver -> gold, each
    appended to ONE table partitioned by a hash bucket of the tenant (no
    per-tenant schema or DDL; a bounded number of folders however many tenants
    there are), rows sorted by tenant inside the files.

    Incremental: bronze keeps every delivery, silver and gold get the batch's
    records that they don't hold yet, so a batch loaded again, or a record
    delivered again in a later batch, adds nothing to them.  The look-ups filter
    by the batch's buckets, so other folders are not read."""
    keep = [tenant_col]
    spark = raw.sparkSession
    ident = ["tenant_bucket", tenant_col, "record_id"]
    path = scratch_path(spark, "tenant_layers")

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("tenant_bucket", tables.tenant_bucket(tenant_col))

    def write(df: DataFrame, table: str) -> None:
        w = (df.hint("rebalance", "tenant_bucket").sortWithinPartitions(tenant_col)
             .write.mode("append").partitionBy("tenant_bucket"))
        w.parquet(table) if "/" in table else w.saveAsTable(table)

    def unseen(df: DataFrame, table: str) -> DataFrame:
        if not tables.table_exists(spark, table):
            return df
        held = stored_in_buckets(tables.read_table(spark, table).select(*ident), df)
        return df.join(held, ident, "left_anti").select(*df.columns)

    landed = medallion.bronze(raw, as_of=as_of, with_stamp=True, keep_cols=keep)
    landed.write.parquet(f"{path}/batch")
    batch = spark.read.parquet(f"{path}/batch")
    write(bucketed(batch), bronze_table)
    silver = bucketed(medallion.silver_clean(batch, schema, as_of=as_of, with_stamp=True, keep_cols=keep))
    silver.write.parquet(f"{path}/silver")
    silver = spark.read.parquet(f"{path}/silver")
    write(unseen(silver, silver_table), silver_table)
    gold = bucketed(medallion.gold_features(silver, schema, features, as_of=as_of, with_stamp=True, keep_cols=keep))
    write(unseen(gold, gold_table), gold_table)
