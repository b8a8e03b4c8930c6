"""Plan lint over every registered batch query: no cross joins of any kind,
and column pruning reaches the parquet scan."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMOKE

BATCH = sorted(k for k in E.queries() if not k.startswith("stream_"))


@pytest.mark.parametrize("key", BATCH)
def test_no_cross_joins(spark, key):
    df = E.queries()[key](spark, SF_SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["latest_state"](spark, SF_SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)


def test_small_side_join_moves_no_raw_row(spark):
    """Counts and maps are landed: by their measured size they are broadcast
    without an exchange of the raw rows, and beyond the threshold the join is a
    sort-merge join that adaptive execution can split."""
    from keelson.operators import encode, prep
    raw = spark.range(20_000).selectExpr("id", "concat('c', id % 50) as cat", "repeat('x', 200) as wide")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, join, moved in (("20k", "BroadcastHashJoin", False), ("-1", "SortMergeJoin", True)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            for df in (prep.fold_rare(raw, "cat", 10), encode.apply_category_map(raw, "cat", encode.fit_category_map(raw, "cat"))):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert join in plan and ("Exchange hashpartitioning" in plan) == moved
                assert df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_look_ups_are_pruned_by_the_batch(spark, tmp_dir):
    """Stored rows that a batch cannot repeat are not read: literal bucket and time filters reach the scan."""
    from keelson.plans import workflows
    from keelson.sources import tables
    held = spark.range(2000).selectExpr("concat('c', id) as customer_id", "timestamp_seconds(id * 60) as timestamp")
    table = f"{tmp_dir}/layer"
    held.withColumn("tenant_bucket", tables.tenant_bucket("customer_id")).write.partitionBy("tenant_bucket").parquet(table)
    batch = spark.createDataFrame([("c5",), ("c5",)], "customer_id string").withColumn("tenant_bucket", tables.tenant_bucket("customer_id"))
    pruned = workflows.stored_in_buckets(spark.read.parquet(table), batch)
    number = batch.first()["tenant_bucket"]
    assert {r[0] for r in pruned.select("tenant_bucket").distinct().collect()} == {number}
    filters = re.search(r"PartitionFilters: \[([^]]*)\]", pruned._jdf.queryExecution().executedPlan().toString())[1]
    assert str(number) in filters
    payload = spark.createDataFrame([("1970-01-01 02:00:00",), ("1970-01-01 03:00:00",)], "request_time string").selectExpr(
        "cast(request_time as timestamp) as request_time")
    span = workflows.stored_in_span(spark.read.parquet(table), payload)
    assert span.count() == 61
    assert "GreaterThanOrEqual(timestamp," in span._jdf.queryExecution().executedPlan().toString()


def test_features_are_evaluated_once_for_both_sides(spark, tmp_dir):
    """The split job scans its input in one landing pass; both sides read what was landed."""
    from keelson.plans import fixtures as fx
    from keelson.plans import workflows
    raw = fx.entity_raw(fx.table(spark, SF_SMOKE, "part"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    workflows.prepare_training_data(spark, raw.mapInArrow(count, raw.schema), fx.ENTITY_SPEC, f"{tmp_dir}/train", f"{tmp_dir}/test")
    rows_in = raw.count()
    assert rows_in <= seen.value <= 2 * rows_in       # once for the rare values, once for the rows
