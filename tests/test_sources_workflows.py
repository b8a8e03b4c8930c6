import os

import pytest
from pyspark.sql import functions as F

from keelson.operators import prep, synth
from keelson.plans import fixtures as fx
from keelson.plans import workflows
from keelson.sources import tables
from tests.conftest import SF_SMOKE, rows


def test_csv_scan_with_header_and_schema(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "w") as f:
        f.write("PageID,Height (m),Alive\n1,1.8,Alive\n2,,Dead\n")
    df = tables.scan_csv(spark, path, "PageID long, `Height (m)` double, Alive string")
    assert rows(df) == [(1, 1.8, "Alive"), (2, None, "Dead")]


def test_json_feed(spark, tmp_dir):
    path = os.path.join(tmp_dir, "feed.json")
    with open(path, "w") as f:
        f.write('[{"customer_id": "1", "is_active": 1}, {"customer_id": "2"}]')
    df = tables.read_json_feed(spark, path, "customer_id string, is_active int", multiline=True)
    assert rows(df) == [("1", 1), ("2", None)]


def test_require_columns_and_signature(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError, match="missing required columns: z"):
        tables.require_columns(df, ["x", "z"])
    sig = tables.schema_json(df, ["x"])
    tables.check_signature(df, sig)
    with pytest.raises(ValueError):
        tables.check_signature(df.select(F.col("x").cast("string").alias("x")), sig)


def test_control_table_latest_wins(spark, tmp_dir):
    t = os.path.join(tmp_dir, "control")
    tables.control_set(spark, t, True, as_of=F.lit("2024-01-01").cast("timestamp"))
    tables.control_set(spark, t, False, as_of=F.lit("2024-02-01").cast("timestamp"))
    assert tables.control_get(spark, t).first()["allow_training"] is False


def test_provision_layers_idempotent(spark):
    names = tables.provision_layers(spark, "tenant_layers")
    tables.provision_layers(spark, "tenant_layers")
    assert names == ["tenant_layers.bronze_raw", "tenant_layers.silver_clean", "tenant_layers.gold_features"]
    cols = spark.table("tenant_layers.gold_features").columns
    assert cols == ["record_id", "feature_1", "feature_2", "label", "train_ts", "customer_id", "tenant_bucket"]


def test_snapshot_manifest(spark, tmp_dir):
    d = os.path.join(tmp_dir, "snap")
    assert tables.latest_snapshot(spark, d) is None
    tables.write_snapshot(spark, spark.range(3), d, 1)
    tables.write_snapshot(spark, spark.range(5), d, 2)
    tables.write_snapshot(spark, spark.range(5), d, 2)  # retried commit
    assert tables.latest_snapshot(spark, d).count() == 5
    assert tables.latest_snapshot(spark, d, before=2).count() == 3


def test_prepare_training_data(spark, tmp_dir):
    raw = fx.entity_raw(fx.table(spark, SF_SMOKE, "part"))
    tr, te = os.path.join(tmp_dir, "train"), os.path.join(tmp_dir, "test")
    workflows.prepare_training_data(spark, raw, fx.ENTITY_SPEC, tr, te,
                                    as_of=F.lit("2024-01-01").cast("timestamp"))
    a, b = spark.read.parquet(tr), spark.read.parquet(te)
    full = prep.feature_prep(raw, fx.ENTITY_SPEC)
    assert a.count() + b.count() == full.count()
    assert a.join(b, "Id").count() == 0
    assert "update_timestamp_utc" in a.columns


def test_refresh_monitoring_observes_counts(spark, tmp_dir):
    pay = fx.payload_table(fx.table(spark, SF_SMOKE, "events"))
    out = os.path.join(tmp_dir, "monitoring")
    counts = workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out,
                                          model_name="m", passthrough=["request_id"])
    written = spark.read.parquet(out)
    assert counts["n_written"] == written.count() == counts["n_with_prediction"]


def test_train_and_register_first_run_then_gate(spark, tmp_dir):
    docs = fx.table(spark, SF_SMOKE, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    lab = docs.join(fx.table(spark, SF_SMOKE, "labels").select("doc_id", "quality"), "doc_id")
    tr, te = lab.where(F.col("doc_id") % 5 != 0), lab.where(F.col("doc_id") % 5 == 0)
    runs, versions, aliases = (os.path.join(tmp_dir, n) for n in ("runs", "versions", "aliases"))
    spark.createDataFrame([], tables.RUNS_SCHEMA).write.parquet(runs)
    spark.createDataFrame([], "model_name string, version string, run_id string, created_at timestamp").write.parquet(versions)
    spark.createDataFrame([], "model_name string, alias string, version string, updated_at timestamp").write.parquet(aliases)
    kw = dict(feature_cols=["lang", "n_chars"], cat_cols=["lang"], label_col="quality", model_name="m",
              runs_table=runs, versions_table=versions, aliases_table=aliases,
              params={"n_estimators": 3, "max_depth": 2})
    _, gate = workflows.train_and_register(spark, tr, te, run_id="run-1", **kw)
    assert gate.first()["improved"] is True
    v = spark.read.parquet(versions)
    assert rows(v, "version", "run_id") == [("1", "run-1")]
    _, gate2 = workflows.train_and_register(spark, tr, te, run_id="run-2", **kw)
    assert gate2.first()["improved"] is True  # same data, same F1: tie passes
    assert rows(spark.read.parquet(versions), "version") == [("1",), ("2",)]
    assert spark.read.parquet(runs).count() == 2


def test_onboard_tenants_twice_adds_nothing(spark, tmp_dir):
    c = fx.table(spark, SF_SMOKE, "customer")
    master = os.path.join(tmp_dir, "master")
    seed = fx.stored_tenants(c)
    from keelson.operators import onboard
    onboard.master_rows(seed, with_stamps=True).write.parquet(master)
    feed = fx.tenant_feed_with_gaps(c)
    rej = workflows.onboard_tenants(spark, feed, master)
    n1 = spark.read.parquet(master).count()
    workflows.onboard_tenants(spark, feed, master)
    assert spark.read.parquet(master).count() == n1
    assert (rej.where("reason like 'Missing field%'").count()
            == feed.join(onboard.reject_reasons(feed).where("not valid"), "customer_id").count())
    assert rej.where("reason = 'Existing id'").count() > 0
    ids = spark.read.parquet(master).groupBy("customer_id").count().where("count > 1")
    assert ids.count() == 0


def test_synthetic_distributions(spark):
    src = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 100).cast("double").alias("x"),
                                    F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("c"),
                                    F.timestamp_seconds(F.col("id") * 60).alias("t"))
    keys = src.select("k")
    out = keys.select("k", synth.synthesize_numeric(src, "k", "x", floor=0.1).alias("x"),
                      synth.synthesize_timestamp(src, "k", "t").alias("t"))
    st = out.agg(F.avg("x"), F.stddev("x"), F.min("x"), F.min("t"), F.max("t")).first()
    assert abs(st[0] - 49.5) < 1.5 and abs(st[1] - 28.9) < 1.5 and st[2] >= 0.1
    bounds = src.agg(F.min("t"), F.max("t")).first()
    assert bounds[0] <= st[3] and st[4] <= bounds[1]
    cat = synth.synthesize_category(src, keys, "k", "c")
    share = cat.agg(F.avg((F.col("c") == "a").cast("double"))).first()[0]
    assert cat.count() == 20000 and abs(share - 0.25) < 0.02
    d = synth.inject_drift(out.withColumn("g", F.lit(None).cast("string")), "k", ["x"], "g", ["M", "F"])
    share_m = d.agg(F.avg((F.col("g") == "M").cast("double"))).first()[0]
    assert abs(share_m - 0.7) < 0.02


def test_tenant_layers_bucketed_and_tenant_read(spark, tmp_dir):
    from keelson.plans.queries import _gold_exprs
    raw = fx.landing_lines(fx.table(spark, SF_SMOKE, "events"))
    names = [os.path.join(tmp_dir, n) for n in ("b", "s", "g")]
    workflows.load_tenant_layers(raw, fx.LANDING_SCHEMA, _gold_exprs(), *names)
    gold = spark.read.parquet(names[2])
    assert gold.select("tenant_bucket").distinct().count() <= tables.TENANT_BUCKETS
    one = tables.tenant_rows(gold, "c7")
    assert one.count() == gold.where("customer_id = 'c7'").count() > 0
    assert "tenant_bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_deployment_decision_matches_deployable_query(spark):
    import __spark_entry__ as E
    from pyspark.sql import functions as F2
    scored = fx.scored_docs(fx.table(spark, SF_SMOKE, "documents"), fx.table(spark, SF_SMOKE, "labels"))
    runs = fx.model_runs(scored)
    versions = fx.model_versions(runs)
    cands = fx.candidates(runs).select("candidate_run_id", "model_name")
    dec = workflows.deployment_decision(cands, runs, versions, fx.model_aliases(versions),
                                        fx.approval_ledger(fx.table(spark, SF_SMOKE, "events")))
    want = E.queries()["deployable"](spark, SF_SMOKE)
    assert rows(dec, "candidate_run_id", "decision") == rows(want, "candidate_run_id", "decision")
    assert dec.where(F2.col("skip_deploy")).count() == 0


def test_tenant_layers_repeat_loads_add_nothing(spark, tmp_dir):
    from keelson.plans.queries import _gold_exprs
    events = fx.table(spark, SF_SMOKE, "events")
    names = [os.path.join(tmp_dir, n) for n in ("b", "s", "g")]
    halves = [events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), events, events]
    for part in halves:
        workflows.load_tenant_layers(fx.landing_lines(part), fx.LANDING_SCHEMA, _gold_exprs(), *names)
    once = [os.path.join(tmp_dir, n) for n in ("b1", "s1", "g1")]
    workflows.load_tenant_layers(fx.landing_lines(events), fx.LANDING_SCHEMA, _gold_exprs(), *once)
    for k in (1, 2):
        ids = ["customer_id", "record_id"]
        assert rows(spark.read.parquet(names[k]), *ids) == rows(spark.read.parquet(once[k]), *ids)


def test_provisioned_layers_load(spark):
    exprs = {"feature_1": F.col("r.value_cents") / 100.0, "feature_2": F.col("r.k").cast("double"),
             "label": (F.col("r.k") > 2).cast("int")}
    names = tables.provision_layers(spark, "tenant_load")
    raw = fx.landing_lines(fx.table(spark, SF_SMOKE, "events"))
    for _ in range(2):
        workflows.load_tenant_layers(raw, fx.LANDING_SCHEMA, exprs, *names)
    gold = spark.table(names[2])
    assert gold.count() == gold.select("customer_id", "record_id").distinct().count() > 0


def test_monitoring_refresh_repeats_in_a_batch_and_other_errors(spark, tmp_dir):
    import pytest
    from pyspark.errors import AnalysisException
    pay = fx.payload_table(fx.table(spark, SF_SMOKE, "events"))
    out = os.path.join(tmp_dir, "mon")
    kw = dict(model_name="m", passthrough=["request_id"])
    first = workflows.refresh_monitoring(pay.unionByName(pay), fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, **kw)
    got = spark.read.parquet(out)
    assert first["n_written"] == got.count() == got.select("request_id", "pos").distinct().count() > 0
    for _ in range(2):
        again = workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, **kw)
        assert again["n_written"] == 0
    other = os.path.join(tmp_dir, "other")
    got.drop("pos").write.parquet(other)
    with pytest.raises(AnalysisException):       # not "first refresh": the table is there but has no such column
        workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, other, **kw)


def test_onboarding_arrival_order_and_reasons(spark, tmp_dir):
    from keelson.operators import onboard
    cols = "customer_id string, customer_name string, schema_name string, cloud_provider string, data_path string, is_active boolean, n int"
    feed = spark.createDataFrame([
        ("1", None, "s", "c", "d", True, 0), ("1", "first", "s", "c", "d", True, 1), ("1", "second", "s", "c", "d", True, 2),
        ("2", "stored", "s", "c", "d", True, 3), ("3", None, "s", "c", "d", True, 4)], cols)
    for order in (["n"], None):
        master = os.path.join(tmp_dir, "by_n" if order else "by_arrival")
        onboard.master_rows(feed.where("customer_id = '2'"), with_stamps=True).write.parquet(master)
        rej = workflows.onboard_tenants(spark, feed.coalesce(1) if order is None else feed, master, order_cols=order)
        assert rows(spark.read.parquet(master), "customer_id", "customer_name") == [("1", "first"), ("2", "stored")]
        assert rows(rej, "customer_id", "reason") == [
            ("1", "Duplicate id"), ("1", "Missing field: customer_name"), ("2", "Existing id"),
            ("3", "Missing field: customer_name")]


def test_alias_log_newest_row_counts(spark):
    from keelson.operators import registry
    runs = spark.createDataFrame([(f"r{i}", f"2024-01-0{i}", {"f1_score": str(f)}) for i, f in ((1, 0.5), (2, 0.9), (3, 0.7))],
                                 "run_id string, start_time string, metrics map<string,string>")
    versions = spark.createDataFrame([("m", "1", "r1"), ("m", "2", "r2")], "model_name string, version string, run_id string")
    aliases = spark.createDataFrame([("m", "latest-model", "1", "2024-01-01"), ("m", "latest-model", "2", "2024-01-02")],
                                    "model_name string, alias string, version string, updated_at string")
    cand = spark.createDataFrame([("r3", "m")], "candidate_run_id string, model_name string")
    gate = registry.gate_decision(cand, runs.unionByName(runs), versions, aliases)
    assert [(r["deployed_version"], r["better"]) for r in gate.collect()] == [("2", False)]
    assert [r["improved"] for r in registry.gate_improved(cand, runs, versions, aliases).collect()] == [False]
    # without the alias the lookup fails and the candidate counts as improved
    none = aliases.where("version = '9'")
    assert [r["improved"] for r in registry.gate_improved(cand, runs, versions, none).collect()] == [True]
    acts = registry.map_actions(spark.createDataFrame([("r1", None), ("r1", "REJECT"), ("r1", "x"), (" ", "APPROVE")],
                                                      "run_id string, action string")).collect()
    assert [(a["approved_flag"], a["error"]) for a in acts] == [
        ("TRUE", None), ("FALSE", None), (None, "Invalid action"), ("TRUE", "Missing run_id")]
