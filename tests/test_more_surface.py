import os

import pandas as pd
from pyspark.sql import functions as F

from keelson.functions import dated_name, iso_stamp
from keelson.operators import encode, synth, train
from keelson.plans import fixtures as fx
from keelson.plans import workflows
from keelson.sources import tables
from keelson.streaming import jobs
from tests.conftest import SF_SMOKE, rows


def test_iso_stamp_and_dated_name(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-03-05 06:07:08.123456' AS t")
    r = df.select(iso_stamp("t"), dated_name("wrapper-gbt", "t")).first()
    assert tuple(r) == ("2024-03-05T06:07:08.123456", "wrapper-gbt-2024-03-05")


def test_insert_row_and_record_inputs(spark, tmp_dir):
    t = os.path.join(tmp_dir, "approvals")
    schema = "run_id string, model_name string, model_version string, status string"
    tables.insert_row(spark, t, ("r1", "m", "3", "PENDING"), schema)
    tables.insert_row(spark, t, ("r2", "m", "4", "PENDING"), schema)
    assert rows(spark.read.parquet(t), "run_id", "status") == [("r1", "PENDING"), ("r2", "PENDING")]
    li = os.path.join(tmp_dir, "run_inputs")
    tables.record_inputs(spark, li, "r1", [("train_set", 3, "training"), ("test_set", 3, "testing")])
    assert rows(spark.read.parquet(li), "table_name", "version", "context") == [
        ("test_set", "3", "testing"), ("train_set", "3", "training")]


def test_refresh_with_empty_payload_writes_nothing(spark, tmp_dir):
    pay = fx.payload_table(fx.table(spark, SF_SMOKE, "events")).where("false")
    out = os.path.join(tmp_dir, "mon")
    counts = workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, model_name="m")
    assert counts["n_written"] == 0


def test_fixed_size_synthetic_rows(spark):
    src = fx.table(spark, SF_SMOKE, "customer")
    keys = synth.synthetic_keys(spark, synth.DEFAULT_TEST_ROWS)
    out = keys.select(synth.synthetic_ids(F.col("k"), 1000).alias("Id"),
                      synth.synthesize_numeric(src, "k", "c_acctbal").alias("c_acctbal"))
    assert out.count() == 100 and out.select("Id").distinct().count() == 100


def test_assemble_and_python_model_hook(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, 3.0, 1.0)], "id int, a double, b double")
    v = encode.assemble(df, ["a", "b"]).select("features").collect()
    assert [list(r[0]) for r in v] == [[0.5, 2.0], [3.0, 1.0]]

    class Model:
        def predict(self, pdf: pd.DataFrame):
            return (pdf["a"] > pdf["b"]).astype("int32")

    out = train.score_with(df, Model, ["a", "b"], ["id"], "id int, prediction int")
    assert rows(out) == [(1, 0), (2, 1)]


def test_csv_approval_ledger_stream(spark, tmp_dir):
    led_dir, state, ck = (os.path.join(tmp_dir, n) for n in ("sheet", "state", "ck"))
    os.makedirs(led_dir)
    schema = "run_id string, approved_flag string, updated_on timestamp, seq long"
    with open(os.path.join(led_dir, "export1.csv"), "w") as f:
        f.write("run_id,approved_flag,updated_on,seq\nr1,maybe,2024-01-01 00:00:00,1\nr2,FALSE,2024-01-01 00:00:00,2\n")
    jobs.run(jobs.ledger_stream(spark, led_dir, spark.createDataFrame([], schema).schema, state, ck, fmt="csv"))
    with open(os.path.join(led_dir, "export2.csv"), "w") as f:
        f.write("run_id,approved_flag,updated_on,seq\nr1, true ,2024-01-02 00:00:00,3\n")
    jobs.run(jobs.ledger_stream(spark, led_dir, spark.createDataFrame([], schema).schema, state, ck, fmt="csv"))
    got = rows(tables.latest_snapshot(spark, state), "run_id", "approved_flag")
    assert got == [("r1", " true "), ("r2", "FALSE")]


def test_incremental_refresh_does_not_reappend(spark, tmp_dir):
    pay = fx.payload_table(fx.table(spark, SF_SMOKE, "events"))
    out = os.path.join(tmp_dir, "mon_inc")
    kw = dict(model_name="m", passthrough=["request_id"], dedup_keys=["request_id", "pos"])
    first = workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, **kw)
    n1 = spark.read.parquet(out).count()
    again = workflows.refresh_monitoring(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, **kw)
    assert first["n_written"] == n1 > 0
    assert again["n_written"] == 0 and spark.read.parquet(out).count() == n1


def test_profile_stream_append_emits_closed_windows(spark, tmp_dir):
    from keelson.operators import monitor
    d = SF_SMOKE
    ev = fx.table(spark, d, "events")
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out, ck = os.path.join(tmp_dir, "prof"), os.path.join(tmp_dir, "ck")
    jobs.run(jobs.profile_stream(fx.monitoring_table(src), out, ck, feature_cols=["value"], watermark="1 hour"))
    got = spark.read.parquet(out)
    batch = monitor.window_profile(fx.monitoring_table(ev), feature_cols=["value"])
    max_ts = fx.monitoring_table(ev).agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.col("window_end") <= F.lit(max_ts) - F.expr("INTERVAL 1 HOUR"))
    assert got.count() > 0
    assert rows(got, "window_start", "model_name", "n_rows") == rows(closed, "window_start", "model_name", "n_rows")


def test_stateful_sink_replay_is_idempotent(spark, tmp_dir):
    from keelson.streaming.jobs import _stateful_sink
    state = os.path.join(tmp_dir, "state")

    def step(prev, batch):
        return batch if prev is None else prev.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n"))

    body = _stateful_sink(spark, state, None, step)
    b0 = spark.createDataFrame([("a", 1)], "k string, n long")
    b1 = spark.createDataFrame([("a", 2), ("b", 5)], "k string, n long")
    body(b0, 0)
    body(b1, 1)
    body(b1, 1)  # replay after a failure between sink commit and checkpoint commit
    assert rows(tables.latest_snapshot(spark, state)) == [("a", 3), ("b", 5)]


def _landed_payloads(spark, tmp_dir, ordered):
    pay = fx.payload_table(fx.table(spark, SF_SMOKE, "events"))
    landing = os.path.join(tmp_dir, "landing")
    if ordered:   # files land in time order, one slice after another, as a serving log does
        edges = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2099-01-01"]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            t = F.col("request_time")
            (pay.where((t >= F.lit(lo).cast("timestamp")) & (t < F.lit(hi).cast("timestamp")))
             .coalesce(1).write.parquet(os.path.join(landing, f"slice={i}")))
    else:         # files land in arbitrary time order
        pay.repartition(6).write.parquet(landing)
    return pay, landing


def _stream_rows(spark, tmp_dir, pay, landing, mode):
    from keelson.operators import monitor
    out, ck = os.path.join(tmp_dir, f"out-{mode}"), os.path.join(tmp_dir, f"ck-{mode}")
    kw = dict(dedup_key="request_id", dedup_mode=mode, model_name="m", passthrough=["request_id"],
              max_files_per_trigger=1)
    q = jobs.flatten_stream(spark, landing, pay.schema, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, ck, **kw)
    jobs.run(q)
    assert len(q.recentProgress) >= 2          # several micro-batches
    batch = monitor.flatten_payload(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, model_name="m",
                                    passthrough=["request_id"])
    cols = ["request_id", "event_id", "prediction"]
    return rows(spark.read.parquet(out), *cols), rows(batch, *cols)


def test_exact_dedup_stream_out_of_order_equals_batch(spark, tmp_dir):
    pay, landing = _landed_payloads(spark, tmp_dir, ordered=False)
    got, want = _stream_rows(spark, tmp_dir, pay, landing, "sink")
    assert got == want


def test_watermark_dedup_stream_in_time_order_equals_batch(spark, tmp_dir):
    pay, landing = _landed_payloads(spark, tmp_dir, ordered=True)
    got, want = _stream_rows(spark, tmp_dir, pay, landing, "watermark")
    assert got == want
