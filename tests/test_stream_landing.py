"""Stream queries land their payloads in parallel: a delivery is one micro-batch, of as many files as its tasks write."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keelson.operators import monitor
from keelson.plans import fixtures as fx
from keelson.streaming import queries as sq


@pytest.fixture
def events_dir(spark, tmp_dir):
    """31 days with an event every 3 minutes; one user's id is missing and some rows come twice."""
    n = F.col("id")
    ev = spark.range(14_880).select(
        n.alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(n * 3).cast("int"))).cast("timestamp_ntz").alias("ts"),
        F.nullif(n % 37, F.lit(5)).alias("user_id"), F.lit("view").alias("event_type"), (n % 100).cast("double").alias("value"),
        F.lit("{}").alias("props"))
    ev.unionByName(ev.where("event_id % 500 = 0")).write.parquet(os.path.join(tmp_dir, "events.parquet"))
    return tmp_dir


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "4",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def run_in(monkeypatch, tmp_dir, spark, query, d):
    """The query's rows, and the number of files with rows in each landed folder."""
    monkeypatch.setattr(sq, "scratch_path", lambda spark, name: os.path.join(tmp_dir, name))
    got = query(spark, d)
    folders = {}
    for f in glob.glob(os.path.join(tmp_dir, "stream_*", "landing", "**", "*.parquet"), recursive=True):
        if os.path.isfile(f) and pq.read_metadata(f).num_rows:
            folders[os.path.dirname(f)] = folders.get(os.path.dirname(f), 0) + 1
    return got, folders


def test_late_row_slices_are_not_written_by_one_task(spark, tmp_dir, events_dir, small_splits, monkeypatch):
    got, folders = run_in(monkeypatch, tmp_dir, spark, sq.q_stream_late_rows, events_dir)
    assert len(folders) == len(sq.LATE_SLICES) and all(n > 1 for n in folders.values())
    t = F.col("request_time")
    pay = fx.payload_table(fx.table(spark, events_dir, "events")).cache()
    sizes = [pay.where((t >= F.lit(a).cast("timestamp")) & (t < F.lit(b).cast("timestamp"))).count() for a, b in sq.LATE_SLICES]
    rows = {r["batch"]: r for r in got.collect()}
    assert [rows[i]["n_input"] for i in range(5)] == sizes                     # a slice is one batch
    assert all(r["n_input"] == r["n_on_time"] + r["n_repeated"] + r["n_late"] for r in rows.values())
    assert rows[1]["n_late"] == sizes[1] and rows[3]["n_repeated"] > 0
    pay.unpersist()


def test_late_row_slices_without_rows_are_batches(spark, tmp_dir, monkeypatch):
    ev = spark.createDataFrame([(1, "2024-01-09", 1, "view", 1.0, "{}"), (2, None, 1, "view", 1.0, "{}")],
                               "event_id long, ts string, user_id long, event_type string, value double, props string")
    ev.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(os.path.join(tmp_dir, "events.parquet"))
    got, _ = run_in(monkeypatch, tmp_dir, spark, sq.q_stream_late_rows, tmp_dir)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 0, 0)] + [(i, 0, 0, 0, 0) for i in range(1, 5)]


def test_exact_dedup_deliveries_are_not_written_by_one_task(spark, tmp_dir, events_dir, small_splits, monkeypatch):
    got, folders = run_in(monkeypatch, tmp_dir, spark, sq.q_stream_dedup_exact, events_dir)
    assert len(folders) == 6 and all(n > 1 for n in folders.values())
    assert len(glob.glob(os.path.join(tmp_dir, "stream_dedup_exact", "out", "commit=d*"))) == 6       # a delivery is one batch
    pay = fx.payload_table(fx.table(spark, events_dir, "events"))
    once = monitor.flatten_payload(pay, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, align="position", model_name="events-model",
                                   passthrough=["request_id", "execution_duration_ms"])
    want = once.unionByName(once.where("request_id is null"))                 # rows without a key all stay
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
