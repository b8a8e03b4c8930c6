from pyspark.sql import functions as F

from keelson.operators import changes, onboard, registry
from tests.conftest import rows


def _registry(spark):
    runs = spark.sql("""SELECT * FROM VALUES
        ('r1', TIMESTAMP '2024-01-01 00:00:00', map('accuracy', '0.80', 'f1_score', '0.70')),
        ('r2', TIMESTAMP '2024-01-02 00:00:00', map('accuracy', '0.80', 'f1_score', '0.75')),
        ('r3', TIMESTAMP '2024-01-03 00:00:00', map('f1_score', '0.90')),
        ('r4', TIMESTAMP '2024-01-04 00:00:00', map('accuracy', 'bad', 'f1_score', '0.60'))
        AS t(run_id, start_time, metrics)""")
    versions = spark.sql("""SELECT * FROM VALUES ('m', '9', 'r1'), ('m', '10', 'r2') AS t(model_name, version, run_id)""")
    return runs, versions


def test_version_max_is_numeric(spark):
    _, versions = _registry(spark)
    r = registry.max_version(versions).first()
    assert (r.max_version, r.run_id) == (10, "r2")


def test_gate_decision_alias_fallbacks_and_ties(spark):
    runs, versions = _registry(spark)
    cands = spark.createDataFrame([("r1", "m"), ("r3", "m"), ("r4", "m"), ("r1", "other")],
                                  "candidate_run_id string, model_name string")
    no_alias = spark.createDataFrame([], "model_name string, alias string, version string")
    g = {(r.candidate_run_id, r.model_name): r for r in
         registry.gate_decision(cands, runs, versions, no_alias).collect()}
    # no alias -> highest version (10, r2); r1 ties on accuracy -> not better -> skip
    assert g[("r1", "m")].deployed_version == "10" and g[("r1", "m")].metric_name == "accuracy"
    assert g[("r1", "m")].better is False and g[("r1", "m")].skip_deploy is True
    # r3 has no accuracy: common metric is f1
    assert g[("r3", "m")].metric_name == "f1_score" and g[("r3", "m")].better is True
    # r4 accuracy not a number -> next common metric (f1) in default mode
    assert g[("r4", "m")].metric_name == "f1_score" and g[("r4", "m")].skip_deploy is True
    # unknown model -> version 0, nothing to compare, not skipped
    assert (g[("r1", "other")].deployed_version, g[("r1", "other")].skip_deploy) == ("0", False)
    strict = {r.candidate_run_id: r for r in
              registry.gate_decision(cands.where("model_name = 'm'"), runs, versions, no_alias, strict=True).collect()}
    assert strict["r4"].metric_name is None and strict["r4"].skip_deploy is False
    ties = {r.candidate_run_id: r for r in
            registry.gate_decision(cands.where("model_name = 'm'"), runs, versions, no_alias, tie_passes=True).collect()}
    assert ties["r1"].better is True


def test_gate_improved_alias_and_first_run(spark):
    runs, versions = _registry(spark)
    aliases = spark.createDataFrame([("m", "latest-model", "9")], "model_name string, alias string, version string")
    cands = spark.createDataFrame([("r4", "m"), ("r1", "m"), ("r3", "new")], "candidate_run_id string, model_name string")
    g = {r.candidate_run_id: r for r in registry.gate_improved(cands, runs, versions, aliases).collect()}
    assert g["r1"].improved is True          # tie passes
    assert g["r4"].improved is False
    assert g["r3"].improved is True and g["r3"].deployed_version == "0"


def test_register_versions_numbering(spark):
    runs, versions = _registry(spark)
    new = runs.select("run_id", "start_time", F.lit("m").alias("model_name"))
    out = rows(registry.register_versions(versions, new), "run_id", "version", "is_latest")
    assert out == [("r3", 11, False), ("r4", 12, True)]


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, name string, v int")
    upd = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("c", 30, 1)], "k string, v int, seq int")
    out = rows(registry.upsert(base, upd, ["k"], ["v"], ["seq"]))
    assert out == [("a", "x", 11), ("b", "y", 2), ("c", None, 30)]


def test_resolve_approvals(spark):
    req = spark.createDataFrame([("r1",), ("r2",), ("r9",)], "run_id string")
    led = spark.createDataFrame([
        ("r1", " true ", 1, 1), ("r1", "FALSE", 2, 2), ("r2", "maybe", 1, 3), ("r2", "true", 1, 4),
    ], "run_id string, approved_flag string, updated_on int, seq int")
    out = rows(registry.resolve_approvals(req, led), "run_id", "decision")
    assert out == [("r1", "REJECTED"), ("r2", "APPROVED"), ("r9", "PENDING")]


def test_latest_by_key(spark):
    df = spark.createDataFrame([("u", 1, True), ("u", 3, False), ("v", 2, True)], "k string, t int, f boolean")
    assert rows(registry.latest_by_key(df, ["k"], ["t"], ["f"])) == [("u", False), ("v", True)]
    assert registry.latest_row(df, ["t"]).first()["k"] == "u"


def test_onboarding_twice_adds_nothing(spark):
    feed = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b2")], "customer_id string, customer_name string")
    stored = spark.createDataFrame([("1",)], "customer_id string")
    new = onboard.new_entities(onboard.first_per_key(feed, "customer_id", ["customer_name"]), stored)
    assert rows(new) == [("2", "b")]
    stored2 = stored.unionByName(new.select("customer_id"))
    assert onboard.new_entities(feed, stored2).count() == 0
    st = rows(onboard.classify_ids(feed.withColumn("seq", F.monotonically_increasing_id()), stored,
                                   "customer_id", ["seq"]), "customer_id", "status")
    assert st == [("1", "exists"), ("2", "duplicate"), ("2", "ok")]


def test_reject_reasons(spark):
    df = spark.createDataFrame([("1", None, "s", None, "p"), ("2", "n", "s", "c", "p")],
                               "customer_id string, customer_name string, schema_name string, "
                               "cloud_provider string, data_path string")
    assert rows(onboard.reject_reasons(df)) == [
        ("1", False, "Missing field: customer_name,cloud_provider"), ("2", True, None)]


def test_change_feed_round_trip(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None)], "k int, n string, v double")
    new = spark.createDataFrame([(2, "b", 2.5), (3, "c", None), (4, "d", 4.0)], "k int, n string, v double")
    cf = changes.change_feed(old, new, ["k"])
    assert rows(cf, "k", "change_type") == [(1, "delete"), (2, "update_postimage"), (2, "update_preimage"),
                                            (4, "insert")]
    assert rows(changes.apply_changes(old, cf, ["k"])) == rows(new)


def test_latest_version_numeric(spark):
    man = spark.createDataFrame([("t", "9", 5, 1), ("t", "10", 7, 2)], "table_name string, version string, n_rows int, committed_at int")
    r = changes.latest_version(man).first()
    assert (r.version, r.n_rows, r.n_versions) == (10, 7, 2)


def test_soft_delete_rejects_unknown_ids(spark):
    master = spark.createDataFrame([("1", True), ("2", True), ("3", False)], "customer_id string, is_active boolean")
    dels = spark.createDataFrame([("2",), ("2",), ("9",)], "customer_id string")
    new, rej = onboard.soft_delete(master, dels)
    assert rows(new) == [("1", True), ("2", False), ("3", False)]
    assert rows(rej) == [("9", "unknown id")]
