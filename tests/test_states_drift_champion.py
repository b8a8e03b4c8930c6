"""States kept as deltas, mergeable profiles and sketches, late rows, digests,
stored pipelines and the re-scored champion."""

import os
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from keelson.operators import changes, champion, digests, monitor, onboard, partials, pipeline
from keelson.plans import fixtures as fx
from keelson.sources import tables
from keelson.sources.deltas import DeltaLog
from keelson.streaming import jobs
from tests.conftest import SF_SMOKE, rows

MON = "timestamp timestamp, model_name string, value double, prediction int"


# ------------------------------------------------------------------ deltas

def test_delta_log_folds_replays_and_compacts(spark, tmp_dir):
    log = DeltaLog(spark, tmp_dir, key=["k"], order=["t"])
    assert log.read() is None and log.latest() is None and DeltaLog.open(spark, tmp_dir) is None
    b = [spark.createDataFrame(r, "k string, t int, v string") for r in
         ([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "z")], [("a", 2, "late"), (None, 1, "n")])]
    for i, df in enumerate(b):
        log.commit(i, df)
    log.commit(1, b[1])                                               # replayed
    want = [("a", 3, "z"), ("b", 1, "y"), (None, 1, "n")]
    assert rows(log.latest(), "k", "t", "v") == sorted(want, key=lambda t: (t[0] is None, str(t[0])))
    assert rows(log.latest(before=1), "k", "v") == [("a", "x"), ("b", "y")]
    assert log.compact(after=3) and log.n_deltas() == 0
    log.commit(3, spark.createDataFrame([("b", 9, "w")], "k string, t int, v string"))
    assert rows(DeltaLog.open(spark, tmp_dir).latest(), "k", "v") == [("a", "z"), ("b", "w"), (None, "n")]
    assert rows(log.latest(before=3), "k", "v") == [("a", "z"), ("b", "y"), (None, "n")]
    assert not log.compact(after=2)


def test_delta_look_up_reads_its_buckets_only(spark, tmp_dir):
    log = DeltaLog(spark, tmp_dir, key=["k"])
    log.commit(0, spark.range(500).select(F.col("id").cast("string").alias("k")))
    hit = log.of_keys(spark.createDataFrame([("7",)], "k string"))
    assert "7" in {r["k"] for r in hit.collect()} and hit.count() < 40
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_unreadable_state_is_an_error_not_an_empty_one(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "_manifest"))
    with open(os.path.join(tmp_dir, "_manifest", "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        tables.snapshot_manifest(spark, tmp_dir).collect()


# ------------------------------------------------------ profiles and sketches

def monitoring_rows(n, seed, models=("a", "b", None), hours=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.choice([None, float("nan"), rng.gauss(1e6, 1.0), rng.gauss(1e6, 1.0), float(rng.randrange(5))])
        out.append((f"2024-01-0{rng.randrange(1, 4)} {rng.randrange(hours):02d}:{rng.randrange(60):02d}:00", rng.choice(models), v,
                    rng.choice([0, 1, None])))
    return out


def monitoring(spark, data):
    return spark.createDataFrame(data, "timestamp string, model_name string, value double, prediction int").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")).repartition(3)


def test_refreshes_equal_one_pass(spark, tmp_dir):
    data = monitoring_rows(900, 1)
    log = DeltaLog(spark, tmp_dir, ["day"])
    for i, part in enumerate((data[:300], data[300:310], data[310:])):
        for _ in range(2 if i == 1 else 1):                           # the second is replayed
            partials.refresh_profile(log, i, monitoring(spark, part), ["value"], compact_after=2)
    whole = monitor.window_profile(monitoring(spark, [(t, m, None if v is None or v != v else v, p) for t, m, v, p in data]),
                                   feature_cols=["value"])
    got = partials.profile_of(partials.read_profile(log, ["value"]), ["value"])
    pair = [sorted(([x if not isinstance(x, float) else round(x, 4) for x in r] for r in df.select(*whole.columns).collect()), key=str)
            for df in (got, whole)]
    assert pair[0] == pair[1]


def test_a_refresh_writes_the_windows_it_touches(spark, tmp_dir):
    log = DeltaLog(spark, tmp_dir, ["day"])
    partials.refresh_profile(log, 0, monitoring(spark, monitoring_rows(600, 2)), ["value"])
    late = monitoring(spark, [("2024-01-01 00:05:00", "a", 1.0, 1), ("2024-01-01 00:06:00", "a", 2.0, 0)])
    partials.refresh_profile(log, 1, late, ["value"])
    assert spark.read.parquet(f"{tmp_dir}/commit=d1").count() == 1


def brute_ks(x, y):
    at = np.concatenate([x, y])
    return np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y)).max()


def brute_psi(ref, x, bins=10, floor=1e-6):
    s = np.sort(ref)
    edges = s[np.ceil(np.arange(1, bins) / bins * len(s)).astype(int) - 1]
    p, q = (np.maximum(np.diff(np.concatenate([[0], [np.mean(v <= e) for e in edges], [1]])), floor) for v in (ref, x))
    return float(((q - p) * np.log(q / p)).sum())


@pytest.mark.parametrize("size,k", [(60, 1024), (40_000, 256)])
def test_distances_from_sketches_within_their_bounds(spark, size, k):
    """Small windows are exact; large ones lie within the stated bounds of the exact values."""
    rng = np.random.default_rng(4)
    sides = {}
    for w in range(4):
        x = rng.normal(0.1 * w, 1 + 0.1 * w, size)
        sides[w] = np.round(x, 1) if w == 2 else x
    data = [(f"2024-01-01 0{w}:00:00", "m", float(v), 1) for w, xs in sides.items() for v in xs]
    import pandas as pd
    mon = spark.createDataFrame(pd.DataFrame(data, columns=["timestamp", "model_name", "value", "prediction"])).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")).repartition(4)
    # each window from two partial refreshes
    parts = [partials.window_partials(mon.where(F.pmod(F.hash("value"), F.lit(2)) == i), ["value"], k=k) for i in (0, 1)]
    merged = partials.merge_partials(parts[0].unionByName(parts[1]), ["value"], k=k)
    base = partials.merged_sketch(merged.where("window_start < '2024-01-01 01:00:00'"), "value", k=4 * k)
    got = {r["window_start"].hour: r for r in partials.sketch_distances(merged, base, "value", k=k, reference_k=4 * k).collect()}
    for w, x in sides.items():
        r, ks, psi = got[w], brute_ks(x, sides[0]), brute_psi(sides[0], x)
        assert r["n_values"] == size and r["n_reference"] == size
        if size <= k:
            assert r["ks_error"] == 0 and abs(r["ks"] - ks) < 1e-6 and abs(r["psi"] - psi) < 1e-6
            assert r["psi_low"] == r["psi"] == r["psi_high"]
        else:
            assert 0 < r["ks_error"] < 0.05 and abs(r["ks"] - ks) <= r["ks_error"]
            assert r["psi_low"] - 1e-6 <= psi <= r["psi_high"] + 1e-6 and r["psi_low"] <= r["psi"] <= r["psi_high"]


def test_windows_without_values_or_reference_have_null_distances(spark):
    mon = monitoring(spark, [("2024-01-01 00:00:00", "a", None, 1), ("2024-01-01 00:30:00", "a", 2.0, 1),
                             ("2024-01-01 00:30:00", None, 2.0, 1), ("2024-01-01 01:00:00", "a", 2.0, 1)])
    w = partials.merge_partials(partials.window_partials(mon, ["value"]), ["value"])
    got = partials.sketch_distances(w, partials.previous_windows(w, "value"), "value", by_window=True)
    assert rows(got, "model_name", "n_values", "n_reference", "ks") == [
        ("a", 0, 0, None), ("a", 1, 0, None), ("a", 1, 1, 0.0), (None, 1, 0, None)]


# ------------------------------------------------------------------ streams

PAY = "request_time timestamp, request_id string, request string, response string"


def payload(spark, data):
    body = '{"dataframe_records": [{"event_id": %d, "value": 1.0, "event_type": "x"}]}'
    return spark.createDataFrame([(t, r, body % i, '{"predictions": [1]}') for i, (t, r) in enumerate(data)],
                                 "request_time string, request_id string, request string, response string").withColumn(
        "request_time", F.col("request_time").cast("timestamp"))


def drain(spark, root, mode, **kw):
    out = os.path.join(root, f"out-{mode}")
    jobs.run(jobs.flatten_stream(spark, os.path.join(root, "landing"), payload(spark, []).schema, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA,
                                 out, os.path.join(root, f"ck-{mode}"), dedup_key="request_id", dedup_mode=mode,
                                 max_files_per_trigger=1, **kw))
    return out


BATCHES = [[("2024-01-01 10:00:00", "a"), ("2024-01-01 10:00:00", "a"), ("2024-01-01 10:05:00", None), ("2024-01-01 10:05:00", None)],
           [("2024-01-01 10:00:00", "a"), ("2024-01-01 13:00:00", "b"), (None, "n")],
           [("2024-01-01 10:30:00", "late"), ("2024-01-01 12:00:00", "c"), ("2024-01-01 13:00:00", "b"), (None, "n")]]


@pytest.mark.parametrize("mode", ["late", "sink"])
def test_stream_rows_are_all_accounted_for(spark, tmp_dir, mode):
    for i, data in enumerate(BATCHES):
        payload(spark, data).coalesce(1).write.parquet(os.path.join(tmp_dir, "landing", f"b={i}"))
        out = drain(spark, tmp_dir, mode, watermark="2 hours")
    ids = sorted((r["request_id"] for r in jobs.flattened(spark, out).collect()), key=str)
    if mode == "sink":            # exact: rows without a key all stay, late ones too
        assert ids == sorted(["a", "b", "c", "late", "n", None, None], key=str)
        return
    assert ids == sorted(["a", "b", "c", "n", None, None], key=str)
    assert rows(jobs.late_rows(spark, out), "request_id") == [("late",)]
    assert rows(jobs.batch_counts(spark, out), "batch", "n_input", "n_on_time", "n_repeated", "n_late") == [
        (0, 4, 3, 1, 0), (1, 3, 2, 1, 0), (2, 4, 1, 2, 1)]


def test_sink_with_a_changed_column_is_an_error(spark, tmp_dir):
    payload(spark, BATCHES[0]).coalesce(1).write.parquet(os.path.join(tmp_dir, "landing", "b=0"))
    log = DeltaLog(spark, os.path.join(tmp_dir, "out-sink"), key=["other"])
    log.commit(-1, spark.createDataFrame([("x",)], "other string"))
    with pytest.raises(Exception, match="request_id"):
        drain(spark, tmp_dir, "sink")


def test_listener_reports_rows_dropped_behind_the_watermark(spark, tmp_dir):
    late = jobs.LateRows()
    spark.streams.addListener(late)
    try:
        for i, data in enumerate(BATCHES):
            payload(spark, data).coalesce(1).write.parquet(os.path.join(tmp_dir, "landing", f"b={i}"))
            drain(spark, tmp_dir, "watermark", watermark="1 minute")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(late)
    assert sum(late.dropped.values()) >= 1


def test_onboarding_stream_takes_the_first_valid_row(spark, tmp_dir):
    schema = "customer_id string, customer_name string, schema_name string, cloud_provider string, data_path string, is_active boolean"
    feed_dir, master, ck = (os.path.join(tmp_dir, n) for n in ("feed", "master", "ck"))
    stored = spark.createDataFrame([("s", "stored", "s", "c", "p", True)], schema)
    for i, data in enumerate(([("1", None, "s", "c", "p", True), ("1", "first", "s", "c", "p", None), ("1", "again", "s", "c", "p", True)],
                              [("1", "later", "s", "c", "p", True), ("s", "known", "s", "c", "p", True), ("2", "two", "s", "c", "p", False)])):
        spark.createDataFrame(data, schema).coalesce(1).write.json(os.path.join(feed_dir, f"b={i}"))
        jobs.run(jobs.onboard_stream(spark, feed_dir, spark.createDataFrame([], schema).schema, master, ck, stored=stored))
    assert rows(jobs.latest_snapshot(spark, master), "customer_id", "customer_name", "is_active") == [
        ("1", "first", True), ("2", "two", False), ("s", "stored", True)]
    assert rows(jobs.rejected_rows(spark, master), "customer_id", "reason") == [
        ("1", "Duplicate id"), ("1", "Existing id"), ("1", "Missing field: customer_name"), ("s", "Existing id")]
    # a batch writes its own rows only
    assert spark.read.parquet(f"{master}/commit=d1").count() == 1


# ------------------------------------------------------------------ digests

def test_digested_feed_equals_the_full_join(spark, tmp_dir):
    rng = random.Random(5)
    old = [(i, rng.choice([None, "x", "y"]), rng.choice([None, 1.0, 2.0])) for i in range(400)]
    new = [(i, v if i % 50 else "changed", w) for i, v, w in old if i % 40 != 3] + [(1000 + i, None, 1.0) for i in range(5)]
    a, b = (spark.createDataFrame(x, "id int, v string, w double").repartition(3) for x in (old, new))
    for name, df in (("old", a), ("new", b)):
        digests.write_digested(df, os.path.join(tmp_dir, name), ["id"])
    paths = [os.path.join(tmp_dir, n) for n in ("old", "new")]
    want = changes.change_feed(a, b, ["id"])
    got = digests.digested_change_feed(spark, *paths, ["id"])
    assert rows(got, "id", "change_type", "v", "w") == rows(want, "id", "change_type", "v", "w")
    assert digests.differing_buckets(spark, paths[0], paths[0]) == []
    # (null, x) is not (x, null), and equal rows do not cancel out
    pair = [spark.createDataFrame(x, "id int, v string, u string") for x in ([(1, None, "x"), (2, "a", "a")], [(1, "x", None), (2, "a", "a")])]
    twice = spark.createDataFrame([(2, "a", "a")] * 3, "id int, v string, u string")
    for i, df in enumerate([*pair, pair[0].unionByName(twice)]):
        digests.write_digested(df, os.path.join(tmp_dir, f"n{i}"), ["id"], buckets=4)
    assert len(digests.differing_buckets(spark, f"{tmp_dir}/n0", f"{tmp_dir}/n1")) == 1
    assert len(digests.differing_buckets(spark, f"{tmp_dir}/n0", f"{tmp_dir}/n2")) == 1


def test_a_local_change_reads_its_share_of_the_buckets(spark, tmp_dir):
    a = spark.range(20_000).select("id", (F.col("id") * 2).alias("v"))
    b = a.withColumn("v", F.when(F.col("id").between(5_000, 5_199), F.lit(0)).otherwise(F.col("v")))
    paths = [os.path.join(tmp_dir, n) for n in ("old", "new")]
    for df, p in zip((a, b), paths):
        digests.write_digested(df, p, ["id"], bucket=F.floor(F.col("id") / 100))
    assert digests.differing_buckets(spark, *paths) == [50, 51]           # 1 % of 200 buckets
    feed = digests.digested_change_feed(spark, *paths, ["id"])
    assert feed.count() == 400
    assert "PartitionFilters: [digest_bucket" in feed._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------- stored pipelines and the champion

def labelled(spark, n=400):
    return spark.createDataFrame([(i, ["x", "y", None, "z"][i % 4], float(i % 17), int(i % 4 == 0 or i % 17 > 12)) for i in range(n)],
                                 "id int, c string, a double, label int")


def test_stored_pipeline_scores_alike(spark, tmp_dir):
    df = labelled(spark)
    model = pipeline.classifier_pipeline(["c"], ["a"], "label", {"n_estimators": 3, "max_depth": 3}).fit(df.where("c <> 'z' or c is null"))
    pipeline.save_model(model, tmp_dir + "/m", df, ["c", "a"])
    loaded, signature = pipeline.load_model(spark.newSession(), tmp_dir + "/m")
    a, b = model.transform(df), pipeline.score(loaded, signature, df)
    cols = ["id", "c_code", "prediction"]
    assert rows(a, *cols) == rows(b, *cols)
    codes = {(r["c"], r["c_code"]) for r in b.select("c", "c_code").collect()}
    assert codes == {("x", 0.0), ("y", 1.0), (None, -1.0), ("z", -1.0)}
    with pytest.raises(ValueError, match="missing required columns: a"):
        pipeline.score(loaded, signature, df.drop("a"))
    with pytest.raises(ValueError, match="other than signed"):
        pipeline.score(loaded, signature, df.withColumn("a", F.col("a").cast("string")))


def rule(spark, sql):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST({sql} AS INT) AS prediction FROM __THIS__")])


def test_champion_is_rescored(spark, tmp_dir):
    df = labelled(spark)
    aliases = spark.createDataFrame([("m", "latest-model", "1", "2024-01-01"), ("m", "latest-model", "2", "2024-01-02"),
                                     ("broken", "latest-model", "7", "2024-01-01")],
                                    "model_name string, alias string, version string, updated_at string")
    good, weak = rule(spark, "id % 4 = 0 OR a > 12"), rule(spark, "a > 12")
    pipeline.save_model(good, champion.model_path(tmp_dir, "m", 1), df, ["id", "a"])
    pipeline.save_model(weak, champion.model_path(tmp_dir, "m", 2), df, ["id", "a"])
    kw = dict(models_dir=tmp_dir, aliases=aliases, id_col="id", label_col="label", input_cols=["id", "a"])

    def gate(model, name="m"):
        return champion.gate_rescored(spark, model, df, model_name=name, **kw).first()

    worse, tie, better = gate(rule(spark, "a > 14")), gate(weak), gate(good)
    assert (worse["improved"], tie["improved"], better["improved"]) == (False, True, True)
    assert worse["champion_version"] == "2" and better["new_f1"] == 1.0 and tie["new_f1"] == tie["old_f1"] == better["old_f1"]
    assert worse["diff_high"] < 0 < better["diff_low"] and (tie["diff_low"], tie["diff_high"]) == (0.0, 0.0)
    first, broken = gate(weak, "new"), gate(weak, "broken")
    assert first["improved"] and first["reason"] == "no champion" and first["old_f1"] is None
    assert broken["improved"] and broken["reason"].startswith("champion cannot be scored") and broken["champion_version"] is None


def test_bootstrap_is_paired_and_close_to_resampling(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 1500)
    new = np.where(rng.random(1500) < 0.9, y, 1 - y)
    old = np.where(rng.random(1500) < 0.85, y, 1 - y)
    df = spark.createDataFrame([(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(y, new, old))], "id int, y int, n int, o int")
    got = champion.paired_bootstrap(df, "id", "y", "n", "o", replicates=200).first()

    def f1(p, i):
        tp = ((p == 1) & (y == 1))[i].sum()
        return 2 * tp / (2 * tp + (p != y)[i].sum())

    draws = [f1(new, i) - f1(old, i) for i in (rng.integers(0, 1500, 1500) for _ in range(2000))]
    assert abs(got["new_f1"] - f1(new, slice(None))) < 1e-6
    assert abs(got["diff_low"] - np.quantile(draws, 0.05)) < 0.006 and abs(got["diff_high"] - np.quantile(draws, 0.95)) < 0.006
