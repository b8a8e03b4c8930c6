"""A key holding a third of all rows: results stay exact and the ordered work
of the hot group is spread over many bounded buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.operators import monitor, onboard, prep, registry
from keelson.operators.ordered import running_totals

N = 30000


def _skewed(spark):
    # key "hot" holds 1/3 of the rows, the rest spread over 1000 keys
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 1000).cast("string")).alias("k"),
        F.col("id").alias("seq"), (F.col("id") * 7 % 101).cast("double").alias("v"))


def test_hot_key_aggregates_and_joins_are_exact(spark):
    df = _skewed(spark)
    folded = prep.fold_rare(df, "k", 20)
    assert folded.where("k = 'hot'").count() == N // 3
    assert folded.where("k = 'Other'").count() == 0  # other keys have ~20 rows each
    last = registry.latest_by_key(df, ["k"], ["seq"], ["v"]).where("k = 'hot'").first()
    assert last["v"] == float((N - 3) * 7 % 101)
    ids = onboard.classify_ids(df.select(F.col("k").alias("customer_id"), "seq"),
                               df.limit(0).select(F.col("k").alias("customer_id")), "customer_id", ["seq"])
    counts = {r["status"]: r["count"] for r in ids.groupBy("status").count().collect()}
    assert counts["ok"] == 1001 and counts["duplicate"] == N - 1001
    mon = df.select(F.timestamp_seconds(F.col("seq")).alias("timestamp"), F.col("k").alias("model_name"),
                    F.lit(1).alias("prediction"), "v")
    prof = monitor.window_profile(mon, feature_cols=["v"]).where("model_name = 'hot'")
    assert prof.agg(F.sum("n_rows")).first()[0] == N // 3


def test_hot_group_running_totals_spread_over_buckets(spark):
    df = _skewed(spark).select("k", "seq", F.lit(1).alias("one"))
    out = running_totals(df, ["seq"], ["one"], ["k"], buckets=32, keep_bucket=True)
    ref = df.withColumn("ref", F.sum("one").over(Window.partitionBy("k").orderBy("seq")))
    assert out.join(ref, ["k", "seq", "one"]).where(F.col("cum_one") != F.col("ref")).count() == 0
    sizes = [r["count"] for r in out.where("k = 'hot'").groupBy("__bucket").count().collect()]
    assert len(sizes) >= 24                      # the hot group is cut into many slices
    assert max(sizes) <= 3 * (N // 3) / 32       # and no slice is much above its share
