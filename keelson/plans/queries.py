"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the given tables (through ``keelson.plans.fixtures``) and
runs over them whole.  Column names match ``keelson.plans.oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.columns import (
    allow_or_other, binary_target, contains_any, dated_name, endpoint_slug, epoch_ms, fill_unknown,
    first_match_class, iso_stamp, label_decode, presence_flag, replace_values, safe_double,
)
from keelson.operators import (
    changes, drift, encode, medallion, metrics, monitor, onboard, prep, registry, split, synth,
)
from keelson.plans import fixtures as fx
from keelson.plans import workflows
from keelson.session import prepare, scratch_path
from keelson.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return run
    return deco


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def T(spark, sf_dir, name):  # noqa: N802 - short table accessor
    return fx.table(spark, sf_dir, name)


S = fx.ENTITY_SPEC


# ------------------------------------------------------------ B1 feature prep

@query("rename_project")
def q_rename_project(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    r = prep.rename_columns(raw, dict(S.renames))
    return r.select(F.col("PageID").cast("string").alias("Id"), "Height", "Weight", "Universe",
                    "Marital_Status")


@query("membership_filter")
def q_membership_filter(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    r = raw.withColumn("Identity", fill_unknown("Identity"))
    return r.where(F.col("Identity").isin(list(S.identity_keep))).select("PageID", "Identity")


@query("null_fill")
def q_null_fill(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    cols = ["Universe", "Origin", "Identity", "Gender", "Marital Status"]
    return raw.select("PageID", *[fill_unknown(c).alias(c.replace(" ", "_")) for c in cols])


@query("rare_fold")
def q_rare_fold(spark, d):
    raw = fx.entity_raw(T(spark, d, "part")).withColumn("Universe", fill_unknown("Universe"))
    return prep.fold_rare(raw, "Universe", S.min_count).select("PageID", "Universe")


@query("presence_flag")
def q_presence_flag(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    return raw.select("PageID", presence_flag("Teams").alias("Teams"))


@query("value_map")
def q_value_map(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    return raw.select(
        "PageID",
        allow_or_other(fill_unknown("Gender"), S.gender_keep).alias("Gender"),
        replace_values(fill_unknown("Marital Status"), S.marital_replace).alias("Marital_Status"))


@query("keyword_flags")
def q_keyword_flags(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    origin = fill_unknown("Origin")
    return raw.select("PageID", contains_any(origin, S.magic_keywords).alias("Magic"),
                      contains_any(origin, S.mutant_keywords).alias("Mutant"))


@query("priority_classify")
def q_priority_classify(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    return raw.select("PageID", first_match_class(fill_unknown("Origin"), S.origin_classes).alias("Origin"))


@query("binary_target")
def q_binary_target(spark, d):
    raw = fx.entity_raw(T(spark, d, "part"))
    return (raw.where(F.col("Alive").isin(list(S.target_keep)))
            .select("PageID", binary_target("Alive", S.target_keep[0]).alias("Alive")))


@query("csv_scan")
def q_csv_scan(spark, d):
    """The raw entity table landed as CSV with a header (column names with
    spaces and parentheses, empty fields for nulls), scanned back with an
    explicit schema -- the input step of the feature job."""
    raw = fx.entity_raw(T(spark, d, "part"))
    path = scratch_path(spark, "entity_csv")
    raw.write.option("header", True).csv(path)
    return tables.scan_csv(spark, path, raw.schema)


@query("json_feed")
def q_json_feed(spark, d):
    """The tenant feed landed as JSON records, read with an explicit schema."""
    feed = fx.tenant_feed_with_gaps(T(spark, d, "customer"))
    path = scratch_path(spark, "tenant_feed")
    feed.write.json(path)
    return tables.read_json_feed(spark, path, feed.schema)


@query("feature_prep")
def q_feature_prep(spark, d):
    return prep.feature_prep(fx.entity_raw(T(spark, d, "part")), S)


# ------------------------------------------------------------ B2 payloads

def _flatten(spark, d, align, keep_pos=False):
    pay = fx.payload_table(T(spark, d, "events"))
    return monitor.flatten_payload(
        pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, align=align, model_name="events-model",
        passthrough=["request_id", "execution_duration_ms"], keep_pos=keep_pos)


@query("payload_flatten")
def q_payload_flatten(spark, d):
    return _flatten(spark, d, "first")


@query("payload_flatten_pos")
def q_payload_flatten_pos(spark, d):
    return _flatten(spark, d, "position", keep_pos=True)


@query("prediction_fallback")
def q_prediction_fallback(spark, d):
    return monitor.prediction_fallback(_flatten(spark, d, "position"))


@query("stage_counts")
def q_stage_counts(spark, d):
    pay = fx.payload_table(T(spark, d, "events"))
    return monitor.stage_counts(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA)


@query("epoch_ms")
def q_epoch_ms(spark, d):
    pay = fx.payload_table(T(spark, d, "events"))
    return pay.select("request_id", F.col("request_time").alias("timestamp"),
                      epoch_ms("request_time").alias("timestamp_ms"))


@query("json_parse")
def q_json_parse(spark, d):
    pay = fx.payload_table(T(spark, d, "events"))
    p = monitor.parse_payload(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA)
    recs = F.col("parsed_request.dataframe_records")
    preds = F.col("parsed_response.predictions")
    def size_or_null(a):  # null list -> null, whatever the legacy sizeOfNull setting
        return F.when(a.isNotNull(), F.size(a))

    return p.select("request_id", size_or_null(recs).alias("n_records"),
                    F.get(recs, 0)["event_id"].alias("first_event_id"),
                    size_or_null(preds).alias("n_predictions"),
                    F.get(preds, 0).alias("first_prediction"),
                    F.col("parsed_response.output.request_id").alias("echo_request_id"))


@query("label_decode")
def q_label_decode(spark, d):
    f = _flatten(spark, d, "position")
    return f.select("request_id", "event_id", "prediction", label_decode("prediction").alias("label"))


# ------------------------------------------------------------ B3 monitoring

def _profile(spark, d):
    mon = fx.monitoring_table(T(spark, d, "events"))
    return monitor.window_profile(mon, feature_cols=["value"])


@query("window_profile")
def q_window_profile(spark, d):
    return _profile(spark, d)


@query("window_drift")
def q_window_drift(spark, d):
    return monitor.window_drift(_profile(spark, d), feature="value")


@query("drift_psi")
def q_drift_psi(spark, d):
    b, c = fx.drift_sides(T(spark, d, "events"))
    return drift.binned_divergence(b, c, "value", ["model_name"]).select(
        "model_name", "n_baseline", "n_current", "psi")


@query("drift_js")
def q_drift_js(spark, d):
    b, c = fx.drift_sides(T(spark, d, "events"))
    return drift.binned_divergence(b, c, "value", ["model_name"]).select(
        "model_name", "n_baseline", "n_current", "js")


@query("drift_ks")
def q_drift_ks(spark, d):
    b, c = fx.drift_sides(T(spark, d, "events"))
    return drift.ks_statistic(b, c, "value", ["model_name"])


# ------------------------------------------------------------ B4 runs / gates

def _scored(spark, d):
    return fx.scored_docs(T(spark, d, "documents"), T(spark, d, "labels"))


def _runs(spark, d):
    """The run registry, materialized once (a small stored table in practice)
    so each query reads it instead of re-deriving it per reference."""
    return fx.model_runs(_scored(spark, d)).checkpoint(eager=True)


def _registry(spark, d):
    runs = _runs(spark, d)
    versions = fx.model_versions(runs)
    return runs, versions, fx.model_aliases(versions)


@query("classification_metrics")
def q_classification_metrics(spark, d):
    return metrics.classification_metrics(_scored(spark, d), group_cols=["run_id"])


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(_scored(spark, d), group_cols=["run_id"])


@query("auc_rank")
def q_auc_rank(spark, d):
    return metrics.roc_auc(_scored(spark, d), group_cols=["run_id"])


@query("eval_bundle")
def q_eval_bundle(spark, d):
    """Evaluation bundle per run: threshold metrics + AUC + log-loss, in one pass."""
    sc = _scored(spark, d).withColumn("probability", F.col("score") / (F.col("score") + F.lit(2000.0)))
    return metrics.evaluation_bundle(sc, group_cols=["run_id"])


@query("log_loss")
def q_log_loss(spark, d):
    sc = _scored(spark, d).withColumn("probability", F.col("score") / (F.col("score") + F.lit(2000.0)))
    return metrics.log_loss(sc, "label", "probability", ["run_id"])


@query("run_names")
def q_run_names(spark, d):
    runs = _runs(spark, d)
    return runs.select("run_id", dated_name("wrapper-gbt", "start_time").alias("run_name"),
                       iso_stamp("start_time").alias("created_at_text"))


@query("first_metric")
def q_first_metric(spark, d):
    from keelson.functions.columns import first_present_metric
    runs = _runs(spark, d)
    v, n = first_present_metric("metrics", registry.DEFAULT_GATE_METRICS)
    return runs.select("run_id", n.alias("metric_name"), F.round(v, 6).alias("metric_value"))


@query("version_max")
def q_version_max(spark, d):
    _, versions, _ = _registry(spark, d)
    return registry.max_version(versions)


@query("latest_run")
def q_latest_run(spark, d):
    runs = _runs(spark, d)
    return registry.latest_row(runs.select("run_id", "start_time"), ["start_time", "run_id"])


def _gates(spark, d):
    runs, versions, aliases = _registry(spark, d)
    return runs, versions, aliases, fx.candidates(runs)


@query("gate_decision")
def q_gate_decision(spark, d):
    runs, versions, aliases, cands = _gates(spark, d)
    g = registry.gate_decision(cands.select("candidate_run_id", "model_name"), runs, versions, aliases)
    return g.withColumns({"candidate_metric": F.round("candidate_metric", 6),
                          "deployed_metric": F.round("deployed_metric", 6)})


@query("gate_improved")
def q_gate_improved(spark, d):
    runs, versions, aliases, cands = _gates(spark, d)
    g = registry.gate_improved(cands.select("candidate_run_id", "model_name"), runs, versions, aliases)
    return g.withColumns({"new_metric": F.round("new_metric", 6), "old_metric": F.round("old_metric", 6)})


@query("register_versions")
def q_register_versions(spark, d):
    runs = _runs(spark, d)
    existing = fx.model_versions(runs, max_num=10)
    new = runs.select("run_id", "start_time", fx.model_of(F.col("run_id")).alias("model_name"))
    return registry.register_versions(existing, new)


# ------------------------------------------------------------ B5 approvals

def _approvals(spark, d):
    runs = _runs(spark, d)
    req = fx.candidates(runs).select(F.col("candidate_run_id").alias("run_id"), "model_name", "model_version")
    return registry.resolve_approvals(req, fx.approval_ledger(T(spark, d, "events")))


@query("approval_resolve")
def q_approval_resolve(spark, d):
    return _approvals(spark, d)


@query("approval_map")
def q_approval_map(spark, d):
    led = fx.approval_ledger(T(spark, d, "events"))
    return registry.map_actions(led).select(
        F.col("seq").alias("event_id"), "run_id", "action", "approved_flag", "error")


@query("approval_upsert")
def q_approval_upsert(spark, d):
    """Approval decisions upserted into the request sheet: key (run, model,
    version) compared as text; valid actions only; last decision wins; a
    decision for a key with no request row is appended."""
    runs = _runs(spark, d)
    base = fx.candidates(runs).select(F.col("candidate_run_id").alias("run_id"), "model_name",
                                      "model_version", F.lit("PENDING").alias("approved_flag"))
    acts = registry.map_actions(fx.approval_ledger(T(spark, d, "events"))).where(F.col("error").isNull())
    keys = ["run_id", "model_name", "model_version"]
    upd = acts.select(*[F.col(k).cast("string").alias(k) for k in keys], "approved_flag", "updated_on", "seq")
    return registry.upsert(base, upd, keys, ["approved_flag"], ["updated_on", "seq"])


@query("deployable")
def q_deployable(spark, d):
    runs, versions, aliases, cands = _gates(spark, d)
    g = registry.gate_decision(cands.select("candidate_run_id", "model_name"), runs, versions, aliases)
    dep = registry.deployable(g, _approvals(spark, d))
    return dep.select("candidate_run_id", "deployed_version", "metric_name",
                      F.round("candidate_metric", 6).alias("candidate_metric"),
                      F.round("deployed_metric", 6).alias("deployed_metric"), "decision")


@query("link_build")
def q_link_build(spark, d):
    runs = _runs(spark, d)
    req = fx.candidates(runs).select(F.col("candidate_run_id").alias("run_id"), "model_name", "model_version")
    return registry.approval_links(req, fx.APPROVAL_BASE_URL)


# ------------------------------------------------------------ B6 tenants

@query("new_entities")
def q_new_entities(spark, d):
    c = T(spark, d, "customer")
    new = onboard.new_entities(fx.tenant_feed(c), fx.stored_tenants(c))
    return onboard.master_rows(new)


@query("unique_ids")
def q_unique_ids(spark, d):
    c = T(spark, d, "customer")
    return onboard.classify_ids(fx.tenant_feed_with_repeats(c), fx.stored_tenants(c), "customer_id", ["seq"])


@query("reject_reasons")
def q_reject_reasons(spark, d):
    return onboard.reject_reasons(fx.tenant_feed_with_gaps(T(spark, d, "customer")))


@query("active_entities")
def q_active_entities(spark, d):
    return onboard.active_entities(fx.tenant_feed(T(spark, d, "customer")))


def _soft_delete(spark, d):
    c = T(spark, d, "customer")
    return onboard.soft_delete(fx.tenant_feed(c), fx.delete_requests(c, T(spark, d, "orders")))


@query("soft_delete")
def q_soft_delete(spark, d):
    return _soft_delete(spark, d)[0].select("customer_id", "is_active")


@query("soft_delete_rejects")
def q_soft_delete_rejects(spark, d):
    return _soft_delete(spark, d)[1]


@query("registry_upsert")
def q_registry_upsert(spark, d):
    base = fx.registry_base(T(spark, d, "customer"))
    upd = fx.registry_updates(T(spark, d, "orders"))
    return registry.upsert(base, upd, ["customer_id"], ["is_active", "updated_on"], ["updated_on", "seq"])


@query("change_feed")
def q_change_feed(spark, d):
    old, new = fx.snapshot_pair(T(spark, d, "customer"))
    return changes.change_feed(old, new, ["c_custkey"])


# ------------------------------------------------------------ B7 split

@query("split_assign")
def q_split_assign(spark, d):
    c = T(spark, d, "customer").select("c_custkey")
    return split.assign_split(c, "c_custkey", 0.2, 42, keep_bucket=True)


@query("split_exact")
def q_split_exact(spark, d):
    c = T(spark, d, "customer").select("c_custkey")
    return split.assign_split_exact(c, "c_custkey", seed=42, test_fraction=0.2)


@query("split_counts")
def q_split_counts(spark, d):
    c = T(spark, d, "customer").select("c_custkey")
    return metrics.split_counts(split.assign_split(c, "c_custkey", 0.2, 42))


# ------------------------------------------------------------ B8 medallion

def _bronze(spark, d):
    return medallion.bronze(fx.landing_lines(T(spark, d, "events")))


def _silver(spark, d):
    return medallion.silver_clean(_bronze(spark, d), fx.LANDING_SCHEMA)


@query("bronze_raw")
def q_bronze_raw(spark, d):
    return _bronze(spark, d)


@query("silver_clean")
def q_silver_clean(spark, d):
    return _silver(spark, d)


def _gold_exprs():
    f1 = F.col("r.value_cents") / F.lit(100.0)
    return {"feature_1": f1, "feature_2": F.col("r.k").cast("double"), "label": (f1 >= 50).cast("int")}


@query("gold_features")
def q_gold_features(spark, d):
    return medallion.gold_features(_silver(spark, d), fx.LANDING_SCHEMA, _gold_exprs())


@query("tenant_layers")
def q_tenant_layers(spark, d):
    """All tenants' landed lines -> bronze / silver / gold tables partitioned
    by tenant; the gold table read back."""
    root = scratch_path(spark, "tenant_layers")
    names = [f"{root}/{t}" for t in ("bronze_raw", "silver_clean", "gold_features")]
    workflows.load_tenant_layers(fx.landing_lines(T(spark, d, "events")), fx.LANDING_SCHEMA, _gold_exprs(),
                                 *names, as_of=F.lit(AS_OF).cast("timestamp"))
    return spark.read.parquet(names[2]).drop("tenant_bucket")


# ------------------------------------------------------------ tables / profiles

@query("table_scan")
def q_table_scan(spark, d):
    return T(spark, d, "orders")


@query("head_row")
def q_head_row(spark, d):
    return T(spark, d, "orders").orderBy("o_orderkey").limit(1)


@query("table_version")
def q_table_version(spark, d):
    o = T(spark, d, "orders")
    manifest = changes.manifest_entry(o.withColumn("__v", F.year("o_orderdate")), "orders",
                                      "__v", "o_orderdate")
    return changes.latest_version(manifest)


@query("numeric_profile")
def q_numeric_profile(spark, d):
    return metrics.numeric_profile(T(spark, d, "orders"), ["o_totalprice"], ["o_orderdate"],
                                   ["o_orderstatus"])


@query("value_counts")
def q_value_counts(spark, d):
    return metrics.value_counts(T(spark, d, "part"), "p_type")


@query("distinct_values")
def q_distinct_values(spark, d):
    p = T(spark, d, "part")
    return p.agg(F.count_distinct("p_type").alias("n_distinct_p_type"),
                 F.count_distinct("p_brand").alias("n_distinct_p_brand"),
                 F.count_distinct("p_name").alias("n_distinct_p_name"))


@query("value_freqs")
def q_value_freqs(spark, d):
    return metrics.value_freqs(T(spark, d, "conversations"), "role")


@query("cat_codes")
def q_cat_codes(spark, d):
    p = T(spark, d, "part").select("p_partkey", "p_type")
    return encode.apply_category_map(p, "p_type", encode.fit_category_map(p, "p_type"))


@query("cat_codes_unseen")
def q_cat_codes_unseen(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang")
    m = encode.fit_category_map(docs.where(F.col("lang") != "en"), "lang")
    return encode.apply_category_map(docs, "lang", m)


@query("latest_state")
def q_latest_state(spark, d):
    e = T(spark, d, "events").select(
        "user_id", (F.col("event_type") == "click").alias("allow_training"),
        F.col("ts").alias("updated_on"), "event_id")
    return registry.latest_by_key(e, ["user_id"], ["updated_on", "event_id"],
                                  ["allow_training", "updated_on"])


@query("safe_casts")
def q_safe_casts(spark, d):
    p = T(spark, d, "pages")
    num = F.regexp_extract("url", "/([0-9]+)", 1)
    return p.select("page_id", F.col("page_id").cast("string").alias("page_id_text"),
                    (num).try_cast("int").alias("url_number"),
                    safe_double(num).alias("url_number_d"),
                    F.col("url").startswith("https").cast("int").alias("is_secure"))


@query("name_slug")
def q_name_slug(spark, d):
    s = T(spark, d, "supplier")
    name = F.concat("s_name", F.lit(".models_"), "s_name", F.lit(".quality_classifier"))
    return s.select("s_suppkey", endpoint_slug(name, "dev").alias("endpoint_name"))


# ------------------------------------------------------------ synthetic data

def _synth_numeric(spark, d, decimals=6):
    c = T(spark, d, "customer")
    keys = c.select("c_custkey")
    x = synth.synthesize_numeric(c, "c_custkey", "c_acctbal", seed=42, floor=synth.PHYSICAL_FLOOR,
                                 decimals=decimals)
    return c, keys.select(synth.synthetic_ids(F.col("c_custkey"), fx.ID_BASE).alias("Id"),
                          "c_custkey", x.alias("c_acctbal"))


@query("synth_rows")
def q_synth_rows(spark, d):
    _, rows = _synth_numeric(spark, d)
    return rows.select("Id", "c_acctbal")


@query("synth_category")
def q_synth_category(spark, d):
    c = T(spark, d, "customer")
    keys = c.select(synth.synthetic_ids(F.col("c_custkey"), fx.ID_BASE).alias("Id"), "c_custkey")
    return synth.synthesize_category(c, keys, "c_custkey", "c_mktsegment").select("Id", "c_mktsegment")


@query("drift_inject")
def q_drift_inject(spark, d):
    _, rows = _synth_numeric(spark, d, decimals=None)
    rows = rows.withColumn("c_mktsegment", F.lit(None).cast("string"))
    out = synth.inject_drift(rows, "c_custkey", ["c_acctbal"], "c_mktsegment", ["BUILDING", "AUTOMOBILE"])
    return out.select("Id", "c_acctbal", "c_mktsegment")


# ------------------------------------------------------------ end-to-end jobs

AS_OF = "2024-03-01 00:00:00"  # load stamp of the end-to-end checks (wall clock otherwise)


@query("prepare_dataset")
def q_prepare_dataset(spark, d):
    """CSV landing -> features -> seeded split -> stamped train / test tables,
    read back with the side they landed in."""
    raw = q_csv_scan(spark, d)
    root = scratch_path(spark, "prepare_dataset")
    tr, te = f"{root}/train_set", f"{root}/test_set"
    workflows.prepare_training_data(spark, raw, S, tr, te, as_of=F.lit(AS_OF).cast("timestamp"))
    return (spark.read.parquet(tr).withColumn("split", F.lit("train"))
            .unionByName(spark.read.parquet(te).withColumn("split", F.lit("test"))))


@query("monitoring_refresh")
def q_monitoring_refresh(spark, d):
    """Payloads -> monitoring table (fallback rule, one append), read back."""
    pay = fx.payload_table(T(spark, d, "events"))
    out = scratch_path(spark, "model_monitoring")
    workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, model_name="events-model",
                                 passthrough=["request_id", "execution_duration_ms"],
                                 dedup_keys=["request_id", "pos"])
    return spark.read.parquet(out)


@query("onboard_run")
def q_onboard_run(spark, d):
    """Stored tenants + a feed with gaps and repeats -> master table."""
    c = T(spark, d, "customer")
    master = scratch_path(spark, "customers_master")
    ts = F.lit(AS_OF).cast("timestamp")
    onboard.master_rows(fx.stored_tenants(c), as_of=ts, with_stamps=True).write.parquet(master)
    workflows.onboard_tenants(spark, fx.tenant_feed_with_gaps(c), master, as_of=ts)
    return spark.read.parquet(master)


@query("monitoring_refresh_twice")
def q_monitoring_refresh_twice(spark, d):
    """Payloads delivered twice in a batch, then the batch again: every record once."""
    pay = fx.payload_table(T(spark, d, "events"))
    out = scratch_path(spark, "model_monitoring")
    for batch in (pay.unionByName(pay), pay):
        workflows.refresh_monitoring(batch, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, model_name="events-model",
                                     passthrough=["request_id", "execution_duration_ms"])
    return spark.read.parquet(out)


@query("tenant_layers_two_loads")
def q_tenant_layers_two_loads(spark, d):
    """Two overlapping batches, the second one loaded twice: every record once."""
    root = scratch_path(spark, "tenant_layers")
    names = [f"{root}/{t}" for t in ("bronze_raw", "silver_clean", "gold_features")]
    events = T(spark, d, "events")
    for batch in (events.where("event_id % 3 < 2"), events.where("event_id % 3 > 0"), events.where("event_id % 3 > 0")):
        workflows.load_tenant_layers(fx.landing_lines(batch), fx.LANDING_SCHEMA, _gold_exprs(), *names,
                                     as_of=F.lit(AS_OF).cast("timestamp"))
    return spark.read.parquet(names[2]).drop("tenant_bucket")


@query("onboard_rejects")
def q_onboard_rejects(spark, d):
    """Rejected feed rows with their reasons: gaps, repeats, ids already stored."""
    c = T(spark, d, "customer")
    master = scratch_path(spark, "customers_master")
    ts = F.lit(AS_OF).cast("timestamp")
    onboard.master_rows(fx.stored_tenants(c), as_of=ts, with_stamps=True).write.parquet(master)
    gaps = fx.tenant_feed_with_gaps(c).withColumn("seq", F.lit(0))
    again = fx.tenant_feed_with_gaps(c.where(F.col("c_custkey") % 7 == 0)).withColumn("seq", F.lit(1))
    return workflows.onboard_tenants(spark, gaps.unionByName(again), master, order_cols=["seq"], as_of=ts)


# ------------------------------------------------------------ composed generator

def _synth_orders(spark, d, keys, drift=False):
    return synth.synthesize_table(
        T(spark, d, "orders"), keys, "k", numeric=["o_totalprice"], categories=["o_orderpriority"],
        timestamps=["o_orderdate"], others=["o_orderstatus"], id_base=fx.ID_BASE, decimals=3, drift=drift,
        drift_category="o_orderstatus", drift_values=["P", "F"])


@query("synth_table")
def q_synth_table(spark, d):
    """A synthetic row for every order, all columns."""
    return _synth_orders(spark, d, T(spark, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("synth_test_rows")
def q_synth_test_rows(spark, d):
    """The 100-row test variant with drift."""
    return _synth_orders(spark, d, synth.synthetic_keys(spark, synth.DEFAULT_TEST_ROWS), drift=True)
