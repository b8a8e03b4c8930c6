"""Registered queries over state that grows refresh by refresh.

Each builds its state in several commits (out of time order, one refresh
replayed) and reads it back; the SQL oracle computes the same in one pass.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import champion, digests, lineage, monitor, partials, pipeline
from keelson.plans import fixtures as fx
from keelson.plans import workflows
from keelson.plans.queries import T, query
from keelson.session import landed, scratch_path
from keelson.sources import tables
from keelson.sources.deltas import DeltaLog

FEATURE = "value"


def _refreshed(spark, d, refreshes: int = 3) -> DataFrame:
    """The monitoring windows after three refreshes, the second one delivered twice."""
    events = T(spark, d, "events")
    log = DeltaLog(spark, scratch_path(spark, "profile_state"), ["day"])
    for batch in [0, 1, 1, 2][:refreshes + 1]:
        mon = fx.monitoring_table(events.where(F.pmod(F.col("event_id"), F.lit(refreshes)) == batch))
        partials.refresh_profile(log, batch, mon, [FEATURE], compact_after=2)
    return partials.read_profile(log, [FEATURE])


def _sides(spark, d):
    windows = _refreshed(spark, d)
    end = F.lit(fx.BASELINE_END).cast("timestamp")
    return windows.where(F.col("window_start") < end), windows.where(F.col("window_start") >= end)


@query("window_profile_refreshes")
def q_window_profile_refreshes(spark, d):
    return partials.profile_of(_refreshed(spark, d), [FEATURE])


def _from_baseline(spark, d):
    before, now = _sides(spark, d)
    return partials.sketch_distances(now, partials.merged_sketch(before, FEATURE), FEATURE)


@query("window_psi")
def q_window_psi(spark, d):
    """Every window after the baseline period against the baseline's deciles."""
    return _from_baseline(spark, d).select("model_name", "window_start", "n_values", "n_reference", "psi", "psi_low", "psi_high")


@query("window_ks")
def q_window_ks(spark, d):
    return _from_baseline(spark, d).select("model_name", "window_start", "n_values", "n_reference", "ks", "ks_error")


@query("window_drift_sketched")
def q_window_drift_sketched(spark, d):
    """Every window against the one before, from their sketches."""
    windows = _refreshed(spark, d)
    return partials.sketch_distances(windows, partials.previous_windows(windows, FEATURE), FEATURE, by_window=True,
                                     reference_k=partials.SKETCH_K).select("model_name", "window_start", "n_values", "n_reference", "psi", "ks")


# ------------------------------------------------------------------ change feed

@query("change_feed_digests")
def q_change_feed_digests(spark, d):
    """The feed of ``change_feed``, from two stored snapshots and their digests."""
    root = scratch_path(spark, "digested")
    for name, side in zip(("old", "new"), fx.snapshot_pair(T(spark, d, "customer"))):
        digests.write_digested(side, f"{root}/{name}", ["c_custkey"])
    return digests.digested_change_feed(spark, f"{root}/old", f"{root}/new", ["c_custkey"])


@query("snapshot_digests")
def q_snapshot_digests(spark, d):
    """Rows per differing bucket of ids, a hundred to a bucket, where a range of ids changed."""
    root = scratch_path(spark, "digested")
    old = T(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = old.withColumn("c_acctbal", F.when(F.col("c_custkey").between(10, 120), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    bucket = F.floor(F.col("c_custkey") / 100)
    for name, side in (("old", old), ("new", new)):
        digests.write_digested(side, f"{root}/{name}", ["c_custkey"], bucket=bucket)
    differ = digests.differing_buckets(spark, f"{root}/old", f"{root}/new")
    rows = spark.read.parquet(f"{root}/new/rows").where(F.col(digests.BUCKET).isin(differ))
    return rows.groupBy(F.col(digests.BUCKET).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------- stored models and gates

def _rule(minimum: int) -> PipelineModel:
    """A stored model whose scores SQL can restate: long documents are good."""
    return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST(n_chars >= {minimum} AS INT) AS prediction FROM __THIS__")])


def _evaluation(spark, d) -> DataFrame:
    docs = T(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return docs.join(T(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("gate_rescored")
def q_gate_rescored(spark, d):
    """A candidate against the stored model behind the alias, on the same rows."""
    root, rows = scratch_path(spark, "models"), landed(_evaluation(spark, d), "evaluation")
    pipeline.save_model(_rule(fx.CHAMPION_CHARS), champion.model_path(root, fx.MODEL_NAME, 3), rows, ["n_chars"])
    aliases = spark.createDataFrame([(fx.MODEL_NAME, "latest-model", "3")], "model_name string, alias string, version string")
    return champion.gate_rescored(spark, _rule(fx.CANDIDATE_CHARS), rows, models_dir=root, model_name=fx.MODEL_NAME, aliases=aliases,
                                  id_col="doc_id", label_col="label", input_cols=["n_chars"])


def _trained(spark, d):
    """Four candidates in turn through the registration job."""
    root, rows = scratch_path(spark, "training"), landed(_evaluation(spark, d), "evaluation")
    store = workflows.ModelStore.at(root)
    store.create(spark)
    tables.control_set(spark, store.control, True, as_of=F.lit("2024-01-01").cast("timestamp"))
    for k, minimum in enumerate(fx.TRAINED_CHARS):
        workflows.register_candidate(
            spark, store, _rule(minimum), rows, run_id=f"run-{k}", model_name=fx.MODEL_NAME, id_col="doc_id", label_col="label",
            input_cols=["n_chars"], params={"minimum": minimum}, inputs=[("documents", k, "training"), ("labels", k, "evaluation")],
            as_of=F.lit(fx.BASELINE_END).cast("timestamp") + F.expr(f"INTERVAL {k} DAYS"))
    tables.control_set(spark, store.control, False, as_of=F.lit("2024-02-01").cast("timestamp"))   # as deployment does
    return store


@query("train_register_runs")
def q_train_register_runs(spark, d):
    """Every run with its metric and, where it beat the champion of its day, its version."""
    store = _trained(spark, d)
    runs, versions = tables.read_table(spark, store.runs), tables.read_table(spark, store.versions)
    return (runs.select("run_id", F.element_at("metrics", F.lit("f1_score")).cast("double").alias("f1"))
            .join(versions.select("run_id", F.col("version").cast("int").alias("version")), "run_id", "left")
            .select("run_id", F.round("f1", 6).alias("f1"), "version"))


@query("run_lineage")
def q_run_lineage(spark, d):
    """What the runs of the registration job read, and the control flag after them."""
    store = _trained(spark, d)
    flag = tables.control_get(spark, store.control).select("allow_training").scalar()
    return tables.read_table(spark, store.inputs).select("run_id", "table_name", "version", "context", flag.alias("training_allowed"))


@query("pipeline_codes")
def q_pipeline_codes(spark, d):
    """A pipeline of category codes and assembly: fitted, stored, loaded, applied."""
    docs = T(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    stages = [pipeline.CategoryCodes(inputCols=["lang"], outputCols=["lang_code"]),
              VectorAssembler(inputCols=["lang_code", "n_chars"], outputCol="features", handleInvalid="keep")]
    path = scratch_path(spark, "pipeline")
    pipeline.save_model(Pipeline(stages=stages).fit(docs.where("lang <> 'en'")), path, docs, ["lang", "n_chars"])
    out = pipeline.score(*pipeline.load_model(spark, path), docs)
    features = vector_to_array("features")
    return out.select("doc_id", F.col("lang_code").cast("int").alias("lang_code"), features[0].alias("first"), features[1].alias("second"))


# ------------------------------------------------------------------ lineage

@query("lineage_closure")
def q_lineage_closure(spark, d):
    """All tables a run depends on; the derivations of the fixture have cycles."""
    inputs, derived = fx.lineage_tables(T(spark, d, "orders"), T(spark, d, "customer"))
    return lineage.ancestors(inputs, derived)


# ------------------------------------------------------------------ typed parse

@query("payload_typed")
def q_payload_typed(spark, d):
    """All ten record fields, numbers in strings and double predictions read as numbers."""
    good, _ = monitor.parse_records(fx.entity_payloads(T(spark, d, "part")), fx.ENTITY_FIELDS, keep=["request_id"])
    return good.select("request_id", "pos", *[c for c, _ in fx.ENTITY_FIELDS], "prediction")


@query("payload_rejects")
def q_payload_rejects(spark, d):
    """Records that don't fit, with the reason."""
    _, bad = monitor.parse_records(fx.entity_payloads(T(spark, d, "part")), fx.ENTITY_FIELDS, keep=["request_id"])
    return bad.select("request_id", "pos", "reason")


# ------------------------------------------------------- tables written and read back

STAMP = "2024-03-01 00:00:00"


@query("control_flag")
def q_control_flag(spark, d):
    """Every click and error as a control row; the latest decides."""
    table = scratch_path(spark, "training_control")
    events = T(spark, d, "events").where(F.col("event_type").isin("click", "error"))
    at = fx.as_utc_timestamp("ts", "timestamp_ntz") + F.make_interval(secs=F.col("event_id") / F.lit(1000000.0))
    tables.append(events.select((F.col("event_type") == "click").alias("allow_training"), at.alias("updated_on")), table)
    tables.control_set(spark, table, False, as_of=F.lit("2000-01-01").cast("timestamp"))     # older than all
    return tables.control_get(spark, table).select("allow_training")


@query("approval_requests")
def q_approval_requests(spark, d):
    """Candidates asked for twice: one pending row each."""
    table, runs = scratch_path(spark, "model_approvals"), fx.model_runs(fx.scored_docs(T(spark, d, "documents"), T(spark, d, "labels")))
    cands = landed(fx.candidates(runs).withColumnRenamed("candidate_run_id", "run_id"), "candidates")
    for part in (cands.where(F.col("model_version").cast("int") % 2 == 0), cands):
        tables.request_approvals(spark, table, part, as_of=F.lit(STAMP).cast("timestamp"))
    return tables.read_table(spark, table)


@query("run_log")
def q_run_log(spark, d):
    """Every run's metrics logged in one write and read back from the map."""
    from keelson.operators.metrics import classification_metrics
    table = scratch_path(spark, "model_runs")
    m = classification_metrics(fx.scored_docs(T(spark, d, "documents"), T(spark, d, "labels")), group_cols=["run_id"])
    tables.log_runs(spark, table, m, ["accuracy", "precision", "recall", "f1"], {"max_depth": 6}, F.lit(STAMP).cast("timestamp"))
    got = tables.read_table(spark, table)
    return got.select("run_id", "start_time", F.element_at("params", F.lit("max_depth")).alias("max_depth"),
                      *[F.element_at("metrics", F.lit(c)).cast("double").alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("tenant_provisioning")
def q_tenant_provisioning(spark, d):
    """The layer tables that active tenants find, after provisioning twice."""
    root = scratch_path(spark, "tenants")
    database = root.rsplit("/", 1)[1].replace("-", "_")
    for _ in range(2):
        names = tables.provision_layers(spark, database, root)
    made = [n.split(".")[1] for n in names if spark.catalog.tableExists(n)]
    layers = F.explode(F.array(*[F.lit(n) for n in made])).alias("layer")
    active = tables.active_tenants(fx.tenant_feed(T(spark, d, "customer")))
    return active.select("customer_id", "schema_name", layers)


@query("monitoring_refresh_all_null")
def q_monitoring_refresh_all_null(spark, d):
    """A refresh without a single prediction keeps every record."""
    table = scratch_path(spark, "model_monitoring")
    pay = fx.payload_table(T(spark, d, "events").where(F.col("user_id") % 10 < 2))
    workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, table, model_name="events-model",
                                 passthrough=["request_id", "execution_duration_ms"])
    return spark.read.parquet(table)
