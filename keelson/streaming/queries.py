"""Registered streaming queries.

Each lands fixture data (derived from the given tables) under the shared
checkpoint folder, drains it with an AvailableNow stream, and returns the
sink read back as a batch DataFrame -- equal to the batch operator's result.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from keelson.operators import partials
from keelson.plans import fixtures as fx
from keelson.plans.queries import T, query
from keelson.session import landed, scratch_path
from keelson.sources.deltas import DeltaLog
from keelson.streaming import jobs


def _land_payloads(spark, d, root):
    pay = fx.payload_table(T(spark, d, "events"))
    landing = os.path.join(root, "landing")
    pay.write.mode("overwrite").parquet(os.path.join(landing, "copy=0"))
    return pay.schema, landing


def _drain_flatten(spark, root, schema, landing, dedup):
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    q = jobs.flatten_stream(spark, landing, schema, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, ck,
                            dedup_key="request_id" if dedup else None, align="position",
                            model_name="events-model", passthrough=["request_id", "execution_duration_ms"])
    jobs.run(q)
    return out


@query("stream_flatten")
def q_stream_flatten(spark, d):
    root = scratch_path(spark, "stream_flatten")
    schema, landing = _land_payloads(spark, d, root)
    out = _drain_flatten(spark, root, schema, landing, dedup=False)
    return spark.read.parquet(out)


@query("stream_dedup")
def q_stream_dedup(spark, d):
    """Two refreshes: the second re-delivers every request (the original's
    re-append); the de-duplicating stream writes each record once."""
    root = scratch_path(spark, "stream_dedup")
    schema, landing = _land_payloads(spark, d, root)
    _drain_flatten(spark, root, schema, landing, dedup=True)
    pay = fx.payload_table(T(spark, d, "events"))
    pay.write.mode("overwrite").parquet(os.path.join(landing, "copy=1"))
    out = _drain_flatten(spark, root, schema, landing, dedup=True)
    return jobs.flattened(spark, out)


@query("stream_dedup_exact")
def q_stream_dedup_exact(spark, d):
    """Exact de-dup: payloads land out of time order in four deliveries (one per
    micro-batch) and are then all re-delivered in two; the sink-keyed mode writes
    every record exactly once and drops nothing as late."""
    root = scratch_path(spark, "stream_dedup_exact")
    pay = landed(fx.payload_table(T(spark, d, "events")), "payloads")
    landing = os.path.join(root, "landing")
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    for copy, n in enumerate((4, 2)):
        delivery = F.pmod(F.xxhash64("request_id", "request_time"), F.lit(n))
        for i in range(n):
            pay.where(delivery == i).write.parquet(os.path.join(landing, f"copy={copy}", f"delivery={i}"))
            jobs.run(jobs.flatten_stream(
                spark, landing, pay.schema, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out, ck,
                dedup_key="request_id", dedup_mode="sink", align="position", model_name="events-model",
                passthrough=["request_id", "execution_duration_ms"]))
    return jobs.flattened(spark, out)


LATE_SLICES = [("2024-01-08", "2024-01-15"), ("2024-01-01", "2024-01-08"), ("2024-01-15", "2024-01-22"),
               ("2024-01-12", "2024-01-22"), ("2024-01-22", "2099-01-01")]


@query("stream_late_rows")
def q_stream_late_rows(spark, d):
    """Payloads land out of time order, a slice per micro-batch, one with requests
    delivered before: every row of a batch is on time, repeated or late."""
    root = scratch_path(spark, "stream_late")
    pay = landed(fx.payload_table(T(spark, d, "events")), "payloads")
    landing, out = os.path.join(root, "landing"), os.path.join(root, "out")
    for i, (first, end) in enumerate(LATE_SLICES):
        t = F.col("request_time")
        part = pay.where((t >= F.lit(first).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))
        part.write.parquet(os.path.join(landing, f"slice={i}"))
        jobs.run(jobs.flatten_stream(spark, landing, pay.schema, fx.REQUEST_SCHEMA, fx.RESPONSE_SCHEMA, out,
                                     os.path.join(root, "ck"), dedup_key="request_id", watermark="2 days",
                                     model_name="events-model", passthrough=["request_id"]))
    return jobs.batch_counts(spark, out)


@query("stream_window")
def q_stream_window(spark, d):
    root = scratch_path(spark, "stream_window")
    ev = T(spark, d, "events")
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    mon = fx.monitoring_table(src)
    state, ck = os.path.join(root, "state"), os.path.join(root, "ck")
    jobs.run(jobs.profile_state_stream(mon, state, ck, feature_cols=["value"]))
    return partials.profile_of(partials.read_profile(DeltaLog(spark, state, ["day"]), ["value"]), ["value"])


@query("stream_onboard")
def q_stream_onboard(spark, d):
    """Feed lands in two batches (even keys, then all keys); stored tenants
    (odd keys) seed the master table; each tenant ends up exactly once."""
    root = scratch_path(spark, "stream_onboard")
    c = T(spark, d, "customer")
    feed = fx.tenant_feed(c)
    feed_dir = os.path.join(root, "feed")
    feed.where(F.col("customer_id").cast("bigint") % 2 == 0).write.mode("overwrite").json(
        os.path.join(feed_dir, "batch=0"))
    master, ck = os.path.join(root, "master"), os.path.join(root, "ck")
    stored = fx.stored_tenants(c)
    jobs.run(jobs.onboard_stream(spark, feed_dir, feed.schema, master, ck, stored=stored))
    feed.write.mode("overwrite").json(os.path.join(feed_dir, "batch=1"))
    jobs.run(jobs.onboard_stream(spark, feed_dir, feed.schema, master, ck, stored=stored))
    return jobs.latest_snapshot(spark, master)


@query("stream_approvals")
def q_stream_approvals(spark, d):
    """Approval ledger landed in three batches by event_id; state = latest row per run."""
    root = scratch_path(spark, "stream_approvals")
    led = fx.approval_ledger(T(spark, d, "events"))
    led_dir = os.path.join(root, "ledger")
    state, ck = os.path.join(root, "state"), os.path.join(root, "ck")
    for i in range(3):
        led.where(F.col("seq") % 3 == i).write.mode("overwrite").parquet(os.path.join(led_dir, f"batch={i}"))
        jobs.run(jobs.ledger_stream(spark, led_dir, led.schema, state, ck))
    return jobs.latest_snapshot(spark, state).select("run_id", "approved_flag", "updated_on", "seq")


@query("stream_approvals_csv")
def q_stream_approvals_csv(spark, d):
    """The ledger as CSV exports with a header, polled by a stream that is started
    anew for every export: its checkpoint keeps the files read."""
    root = scratch_path(spark, "stream_approvals")
    led = fx.approval_ledger(T(spark, d, "events")).drop("action")
    sheet, state, ck = (os.path.join(root, n) for n in ("sheet", "state", "ck"))
    for i in range(2):
        (led.where(F.col("seq") % 2 == i).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(os.path.join(sheet, f"export={i}")))
        for _ in range(2):                      # the second poll finds nothing new
            jobs.run(jobs.ledger_stream(spark, sheet, led.schema, state, ck, fmt="csv"))
    return jobs.latest_snapshot(spark, state).select("run_id", "approved_flag", "updated_on", "seq")
