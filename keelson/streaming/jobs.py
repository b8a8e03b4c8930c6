"""Structured Streaming jobs.

The original refreshes by re-reading every payload and re-appending all of it
(duplicates on every run), polls a sheet every 10 s and re-scans the tenant
feed every minute.  Here each is an incremental stream with a checkpoint:

* ``flatten_stream``  -- landed payload files -> monitoring rows, each request
  once; requests behind the watermark go to a side output and are counted;
* ``profile_stream``  -- tumbling-window profile per model with a watermark, and
  ``profile_state_stream``, which commits partial aggregates of the windows a
  batch touches;
* ``onboard_stream``  -- new tenants only, by the rules of the batch job;
* ``ledger_stream``   -- approval ledger, read as the latest row per key.

State is kept as deltas (``sources.deltas``): a batch writes its own rows, looks
up its own key buckets, and a replayed batch replaces its own commit.

Every job runs with ``Trigger.AvailableNow`` by default (process what has
landed, then stop) -- the scheduled form of the original cron jobs -- and
can run continuously with a processing-time trigger instead.  Checkpoints and
sinks live under the shared checkpoint folder, so a restarted driver or a lost
executor resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from keelson.operators import monitor, onboard, partials, registry
from keelson.session import scratch_path
from keelson.sources.deltas import DeltaLog
from keelson.sources.tables import latest_snapshot, write_snapshot

__all__ = ["flatten_stream", "flattened", "late_rows", "batch_counts", "LateRows", "profile_stream", "profile_state_stream",
           "onboard_stream", "rejected_rows", "ledger_stream", "run", "latest_snapshot"]

COMPACT_AFTER = 32     # deltas behind a base before they are folded into the next one


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now or not interval:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def run(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Block until an AvailableNow query has drained its input."""
    query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


class LateRows(StreamingQueryListener):
    """Rows that built-in operators dropped behind the watermark, by query id:
    ``spark.streams.addListener(LateRows())``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.dropped[str(p.id)] = self.dropped.get(str(p.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _once(batch: DataFrame, key: str, order_cols: Sequence[str],
          held: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """Of the rows of a key the first that is not stored yet; rows without a key
    cannot be told apart and all stay."""
    keyed = batch.where(F.col(key).isNotNull())
    first = onboard.first_per_key(keyed, key, order_cols)
    stored = held(first)
    if stored is not None:
        first = first.join(stored.select(key), key, "left_anti")
    return first.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))


def flatten_stream(spark: SparkSession, landing_dir: str, payload_schema: T.StructType,
                   request_schema: T.StructType, response_schema: T.StructType, out_dir: str,
                   checkpoint: str, *, dedup_key: str | None = None, dedup_mode: str = "late",
                   time_col: str = "request_time", watermark: str = "2 hours", align: str = "position",
                   model_name: str = "model", passthrough: Sequence[str] = (),
                   max_files_per_trigger: int | None = None, available_now: bool = True,
                   interval: str | None = None) -> StreamingQuery:
    """Payload files -> monitoring rows in parquet (append, exactly-once).

    ``dedup_key`` drops re-delivered requests before the explode; rows without a
    key all stay.

    * ``dedup_mode="late"`` -- bounded look-up, nothing lost: requests older than
      the latest time of earlier batches less ``watermark`` go to a side output
      (``late_rows``); the others are looked up in the sink's days from that mark
      on.  ``batch_counts`` has input = on time + repeated + late per batch.  A row
      without a time is never late;
    * ``dedup_mode="sink"`` -- exact whatever the order: each batch is looked up
      in its keys' buckets of the whole sink;
    * ``dedup_mode="watermark"`` -- Spark's ``dropDuplicatesWithinWatermark``:
      state in memory, late rows dropped; a ``LateRows`` listener counts them.
    """
    reader = spark.readStream.schema(payload_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(landing_dir)
    kw = dict(align=align, model_name=model_name, passthrough=passthrough, time_col=time_col)
    if dedup_key and dedup_mode in ("sink", "late"):
        carried = list(dict.fromkeys([*passthrough, dedup_key]))

        def flat(rows: DataFrame) -> DataFrame:
            return monitor.flatten_payload(rows, request_schema, response_schema, **(kw | {"passthrough": carried}))

        body = (_exact_sink(spark, out_dir, dedup_key, time_col, flat) if dedup_mode == "sink"
                else _late_sink(spark, out_dir, dedup_key, time_col, watermark, flat))
        w = src.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        return _trigger(w, available_now, interval).start()
    if dedup_key:
        src = src.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([dedup_key])
    flat = monitor.flatten_payload(src, request_schema, response_schema, **kw)
    w = (flat.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out_dir))
    return _trigger(w, available_now, interval).start()


def _exact_sink(spark: SparkSession, out_dir: str, key: str, time_col: str, flat: Callable[[DataFrame], DataFrame]):
    log = DeltaLog(spark, out_dir, key=[key])

    def body(batch: DataFrame, batch_id: int) -> None:
        fresh = _once(batch, key, [time_col], lambda rows: log.of_keys(rows, before=batch_id))
        log.commit(batch_id, flat(fresh))
    return body


def _late_sink(spark: SparkSession, out_dir: str, key: str, time_col: str, delay: str, flat: Callable[[DataFrame], DataFrame]):
    log, late_log = DeltaLog(spark, out_dir, ["day"]), DeltaLog(spark, f"{out_dir}_late")
    counts = DeltaLog(spark, f"{out_dir}_counts")
    time = F.col(time_col)

    def body(batch: DataFrame, batch_id: int) -> None:
        known = counts.read(before=batch_id)
        mark = None if known is None else known.agg((F.max("last") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        is_late = F.lit(False) if mark is None else F.coalesce(time < F.lit(mark), F.lit(False))
        batch.persist()
        try:
            late, ready = batch.where(is_late), batch.where(~is_late)

            def held(rows: DataFrame) -> DataFrame | None:
                stored = log.read(before=batch_id)
                if stored is None or mark is None:
                    return stored
                return stored.where(F.col("day").isNull() | (F.col("day") >= F.to_date(F.lit(mark))))

            path = scratch_path(spark, "on_time")
            _once(ready, key, [time_col], held).write.parquet(path)
            fresh = spark.read.parquet(path)
            late_log.commit(batch_id, late)
            log.commit(batch_id, flat(fresh).withColumn("day", F.to_date("timestamp")))
            size = batch.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(is_late).alias("n_late"), F.max(time).alias("last"))
            on_time = fresh.agg(F.count(F.lit(1))).scalar()
            counts.commit(batch_id, size.select(F.lit(batch_id).cast("long").alias("batch"), "n_input", on_time.alias("n_on_time"),
                                                (F.col("n_input") - F.col("n_late") - on_time).alias("n_repeated"), "n_late", "last"))
        finally:
            batch.unpersist()
    return body


def flattened(spark: SparkSession, out_dir: str) -> DataFrame:
    """The monitoring rows of a de-duplicating ``flatten_stream``."""
    return spark.read.parquet(out_dir).drop("commit", "day", "key_bucket")


def late_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Payload rows that came behind the watermark."""
    return DeltaLog(spark, f"{out_dir}_late").read().drop("commit")


def batch_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """batch, n_input, n_on_time, n_repeated, n_late: where each batch's rows went."""
    return DeltaLog(spark, f"{out_dir}_counts").read().drop("commit", "last")


def profile_stream(source: DataFrame, out_dir: str, checkpoint: str, *, ts_col: str = "timestamp",
                   watermark: str = "1 hour", feature_cols: Sequence[str] = (), granularity: str = "30 minutes",
                   available_now: bool = True, interval: str | None = None) -> StreamingQuery:
    """Windowed profile of a monitoring stream: each window is appended once the
    watermark closes it and its state is dropped then, so state stays bounded on
    an endless stream.  For windows wanted before they close, and for late rows,
    use ``profile_state_stream``."""
    prof = monitor.window_profile(source.withWatermark(ts_col, watermark), ts_col=ts_col,
                                  feature_cols=feature_cols, granularity=granularity)
    w = (prof.writeStream.format("parquet").outputMode("append").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, interval).start()


def profile_state_stream(source: DataFrame, state_dir: str, checkpoint: str, *, feature_cols: Sequence[str] = (),
                         compact_after: int = COMPACT_AFTER, available_now: bool = True, interval: str | None = None,
                         **profile) -> StreamingQuery:
    """Windowed profile as mergeable state: every batch commits one partial row per
    window it touches, however late its rows are; ``partials.read_profile`` merges
    them.  Bytes written follow the batch, not the table."""
    log = DeltaLog(source.sparkSession, state_dir, ["day"])

    def body(batch: DataFrame, batch_id: int) -> None:
        partials.refresh_profile(log, batch_id, batch, list(feature_cols), compact_after=compact_after, **profile)

    w = source.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def _stateful_sink(spark: SparkSession, table_dir: str, seed: DataFrame | None,
                   step: Callable[[DataFrame, DataFrame], DataFrame]):
    """foreachBatch body: state_{n} = step(state_{n-1}, batch); snapshot per batch,
    for small states that a batch may change anywhere.

    A replayed batch id recomputes from the snapshot *before* its own version
    and rewrites its own folder, so a replay is idempotent and never reads the
    folder it overwrites."""
    def body(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        prev = latest_snapshot(spark, table_dir, before=version)
        if prev is None:
            prev = seed
        write_snapshot(spark, step(prev, batch), table_dir, version)
    return body


def onboard_stream(spark: SparkSession, feed_dir: str, feed_schema: T.StructType, master_dir: str,
                   checkpoint: str, *, stored: DataFrame | None = None, key: str = "customer_id",
                   created_by: str = "feed_onboarding", available_now: bool = True,
                   interval: str | None = None) -> StreamingQuery:
    """Each landed feed batch by the rules of ``workflows.onboard_tenants``: of the
    valid rows of an id the first to arrive enters unless the id is stored; the
    others are kept with their reasons (``rejected_rows``).

    A batch commits its new tenants only and looks ids up in its own buckets."""
    feed = spark.readStream.schema(feed_schema).json(feed_dir)
    log, rejects = DeltaLog(spark, master_dir, key=[key]), DeltaLog(spark, f"{master_dir}_rejects")
    if stored is not None and log.read() is None:
        log.commit(-1, onboard.master_rows(stored, created_by=created_by))

    def body(batch: DataFrame, batch_id: int) -> None:
        path = scratch_path(spark, "onboarding")     # one landing fixes the order of arrival
        arrived = batch.select("*", F.monotonically_increasing_id().alias("__arrival"))
        arrived.write.parquet(f"{path}/feed")
        rows = spark.read.parquet(f"{path}/feed")
        known = log.of_keys(rows, before=batch_id)
        known = rows.select(key).limit(0) if known is None else known.select(key)
        onboard.judge_feed(rows, known, key, ["__arrival"]).write.parquet(f"{path}/judged")
        judged = spark.read.parquet(f"{path}/judged")
        rejects.commit(batch_id, judged.where("reason is not null").drop("__arrival"))
        log.commit(batch_id, onboard.master_rows(judged.where("reason is null"), created_by=created_by))
        log.compact(after=COMPACT_AFTER)

    w = feed.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def rejected_rows(spark: SparkSession, master_dir: str) -> DataFrame:
    """Feed rows that an ``onboard_stream`` turned away, with their reasons."""
    return DeltaLog(spark, f"{master_dir}_rejects").read().drop("commit")


def ledger_stream(spark: SparkSession, ledger_dir: str, ledger_schema: T.StructType, state_dir: str,
                  checkpoint: str, *, key_cols: Sequence[str] = ("run_id",),
                  order_cols: Sequence[str] = ("updated_on", "seq"),
                  value_cols: Sequence[str] = ("approved_flag",), available_now: bool = True,
                  interval: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Approval ledger rows -> latest row per key, read with ``latest_snapshot``.

    A batch commits its own latest rows and reads no state; readers fold them, and
    every COMPACT_AFTER batches the fold becomes the next base.

    ``fmt="csv"`` reads sheet exports with a header row (the original polled
    a published sheet as CSV every 10 s; here each landed export is one
    micro-batch and nothing is re-read)."""
    reader = spark.readStream.schema(ledger_schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    src = reader.format(fmt).load(ledger_dir)
    keys, vals = list(key_cols), list(value_cols) + list(order_cols)
    log = DeltaLog(spark, state_dir, key=keys, order=list(order_cols))

    def body(batch: DataFrame, batch_id: int) -> None:
        log.commit(batch_id, registry.latest_by_key(batch, keys, list(order_cols), vals))
        log.compact(after=COMPACT_AFTER)

    w = src.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()
