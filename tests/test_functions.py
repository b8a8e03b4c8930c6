from pyspark.sql import functions as F

from keelson.functions import (
    action_to_flag, allow_or_other, approval_decision, approval_link, binary_target, contains_any,
    endpoint_slug, epoch_ms, fill_unknown, first_match_class, first_present_metric, flag_text,
    hash_bucket, label_decode, missing_fields, presence_flag, replace_values, safe_double, std_normal,
)
from keelson.operators.prep import DEFAULT_ORIGIN_CLASSES


def test_null_policy_and_flags(spark):
    df = spark.createDataFrame([("a",), (None,), ("Widow",)], "x string")
    out = df.select(fill_unknown("x").alias("f"), presence_flag("x").alias("p"),
                    allow_or_other(fill_unknown("x"), ["a"]).alias("g"),
                    replace_values("x", {"Widow": "Widowed"}).alias("r")).collect()
    assert [tuple(r) for r in out] == [("a", 1, "a", "a"), ("Unknown", 0, "Other", None),
                                       ("Widow", 1, "Other", "Widowed")]


def test_keyword_classifier_first_hit_wins(spark):
    df = spark.createDataFrame([("Inhuman",), ("Human Mutate",), ("MUTANT",), ("Cosmic Being",),
                                ("cosmic",), (None,)], "o string")
    out = [r[0] for r in df.select(first_match_class(fill_unknown("o"), DEFAULT_ORIGIN_CLASSES)).collect()]
    assert out == ["Human", "Human", "Mutant", "Cosmic Being", "Other", "Other"]
    flags = [r[0] for r in df.select(contains_any(fill_unknown("o"), ["mutate", "mutant"])).collect()]
    assert flags == [0, 1, 1, 0, 0, 0]


def test_binary_target_and_label_decode(spark):
    df = spark.createDataFrame([("Alive", 1), ("Dead", 0), (None, None)], "a string, p int")
    out = df.select(binary_target("a", "Alive"), label_decode("p")).collect()
    assert [tuple(r) for r in out] == [(1, "alive"), (0, "dead"), (None, "dead")]


def test_epoch_ms_truncates_to_seconds(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:01.999' AS t")
    assert df.select(epoch_ms("t")).first()[0] == 1704067201000


def test_endpoint_slug(spark):
    df = spark.createDataFrame([("Main.Models_Credit.Risk",), ("x" * 80,)], "n string")
    out = [r[0] for r in df.select(endpoint_slug("n", "prd")).collect()]
    assert out[0] == "main-models-credit-risk-serving-prd"
    assert len(out[1]) == 63


def test_approval_text_rules(spark):
    df = spark.createDataFrame([(" true ", "APPROVE"), ("FALSE", "REJECT"), ("maybe", "OOPS"), (None, None)],
                               "f string, a string")
    out = df.select(approval_decision(flag_text("f")), action_to_flag("a")).collect()
    assert [tuple(r) for r in out] == [("APPROVED", "TRUE"), ("REJECTED", "FALSE"),
                                       ("PENDING", None), ("PENDING", "TRUE")]  # absent: approve


def test_link_is_url_encoded(spark):
    df = spark.createDataFrame([("r 1&x",)], "r string")
    link = df.select(approval_link("https://h/approve", [("run_id", F.col("r")), ("action", F.lit("APPROVE"))])).first()[0]
    assert link == "https://h/approve?run_id=r+1%26x&action=APPROVE"


def test_first_present_metric_decides_even_if_bad(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (map('accuracy', '0.9', 'f1_score', '0.8')),
        (map('f1_score', '0.7')),
        (map('accuracy', 'n/a', 'f1_score', '0.6')),
        (map('other', '1')) AS t(m)""")
    v, n = first_present_metric("m", ["accuracy", "f1_score"])
    out = [tuple(r) for r in df.select(v, n).collect()]
    assert out == [(0.9, "accuracy"), (0.7, "f1_score"), (None, "accuracy"), (None, None)]
    assert df.select(safe_double(F.lit("x1"))).first()[0] is None


def test_missing_fields(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "b", "c")], "x string, y string, z string")
    out = [r[0] for r in df.select(missing_fields(["x", "y", "z"])).collect()]
    assert out == ["y,z", None]


def test_hash_randomness_is_partition_independent(spark):
    df = spark.range(2000)
    a = df.select("id", hash_bucket("id", 42, 10000).alias("b"), std_normal("id", 7).alias("z"))
    b = df.repartition(7).select("id", hash_bucket("id", 42, 10000).alias("b"), std_normal("id", 7).alias("z"))
    assert sorted(a.collect()) == sorted(b.collect())
    stats = a.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(stats[0]) < 0.1 and abs(stats[1] - 1) < 0.1
