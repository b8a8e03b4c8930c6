import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.operators import drift, encode, metrics
from keelson.operators.ordered import running_totals


def test_running_totals_matches_window(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", "c"]), float(i) + rnd.random(), rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v double, w int")
    got = running_totals(df, ["v"], ["w"], ["g"], buckets=16)
    ref = df.withColumn("ref", F.sum("w").over(Window.partitionBy("g").orderBy("v")))
    j = got.join(ref, ["g", "v", "w"])
    assert j.count() == 3000
    assert j.where(F.col("cum_w") != F.col("ref")).count() == 0
    ung = running_totals(df, ["v"], ["w"], buckets=8)
    ref2 = df.withColumn("ref", F.sum("w").over(Window.orderBy("v")))
    assert ung.join(ref2, ["g", "v", "w"]).where(F.col("cum_w") != F.col("ref")).count() == 0


def test_running_totals_on_strings(spark):
    words = ["", "a", "ab", "abc", "b", "ba", "zz", "éa", "Z", "aaaaaaab", "aaaaaaaa"]
    df = spark.createDataFrame([(w, 1) for w in words], "s string, one int")
    got = {r["s"]: r["cum_one"] for r in running_totals(df, ["s"], ["one"], buckets=4).collect()}
    assert [got[w] for w in sorted(words, key=lambda x: x.encode())] == list(range(1, len(words) + 1))


def test_running_totals_strings_with_long_shared_prefix(spark):
    vals = [f"https://example.com/items/{i:06d}" for i in range(2000)]
    df = spark.createDataFrame([(v, 1) for v in vals], "s string, one int")
    got = running_totals(df, ["s"], ["one"], buckets=16)
    assert sorted((r["s"], r["cum_one"]) for r in got.collect()) == [(v, i + 1) for i, v in enumerate(sorted(vals))]
    # one value outside the shared prefix must not put the others into one range
    odd = df.unionByName(spark.createDataFrame([("a", 1)], "s string, one int"))
    spread = running_totals(odd, ["s"], ["one"], buckets=16, keep_bucket=True)
    sizes = [r["count"] for r in spread.groupBy("__bucket").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * 2001 / 16


def test_running_totals_ranges_follow_the_rows(spark, monkeypatch):
    from keelson.operators import ordered
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 100)
    for n in (1000, 10_000):
        df = spark.range(n).select("id", F.lit(1).alias("one"))
        out = running_totals(df, ["id"], ["one"], keep_bucket=True)
        assert abs(out.select("__bucket").distinct().count() - n / 100) <= n / 1000
        assert out.where("cum_one <> id + 1").count() == 0


def test_null_and_one_sided_groups_stay(spark):
    base = spark.createDataFrame([("a", float(i)) for i in range(50)] + [(None, float(i)) for i in range(20)]
                                 + [("gone", 1.0), ("empty", None)], "g string, v double")
    cur = spark.createDataFrame([("a", float(i + 5)) for i in range(50)] + [(None, float(i)) for i in range(20)]
                                + [("new", 2.0)], "g string, v double")
    psi = {r["g"]: r for r in drift.binned_divergence(base, cur, "v", ["g"]).collect()}
    ks = {r["g"]: r for r in drift.ks_statistic(base, cur, "v", ["g"]).collect()}
    for got, stat in ((psi, "psi"), (ks, "ks")):
        assert set(got) == {"a", None, "gone", "new", "empty"}
        assert got["a"][stat] > 0 and got[None][stat] == 0.0 and got[None]["n_baseline"] == 20
        assert got["gone"][stat] is None and (got["gone"]["n_baseline"], got["gone"]["n_current"]) == (1, 0)
        assert got["new"][stat] is None and got["new"]["n_current"] == 1 and got["empty"]["n_baseline"] == 0
    scored = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("r", 1, 0.2), ("r", 0, 0.8)],
                                   "run string, label int, score double")
    assert {r["run"]: r["auc"] for r in metrics.roc_auc(scored, group_cols=["run"]).collect()} == {None: 1.0, "r": 0.0}


def test_category_codes_sorted_and_unseen(spark):
    tr = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "x string")
    m = {r["x"]: r["code"] for r in encode.fit_category_map(tr, "x").collect()}
    assert m == {"a": 0, "b": 1, "c": 2}
    te = spark.createDataFrame([("c",), ("z",), (None,)], "x string")
    out = [r["x_code"] for r in encode.apply_category_map(te, "x", encode.fit_category_map(tr, "x")).orderBy("x").collect()]
    assert sorted(out) == [-1, -1, 2]


def test_classification_metrics_and_zero_denominators(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, prediction int")
    r = metrics.classification_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert r.accuracy == 0.6 and r.precision == round(2 / 3, 6) and r.recall == round(2 / 3, 6)
    assert r.f1 == round(2 / 3, 6)
    z = metrics.classification_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert (z.precision, z.recall, z.f1) == (0.0, 0.0, 0.0)


def test_auc_matches_pairwise(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), float(rnd.randint(0, 30))) for _ in range(400)]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "label int, score double")
    got = metrics.roc_auc(df, buckets=8).first()["auc"]
    assert abs(got - want) < 1e-6


def test_psi_zero_on_same_sample_and_ks(spark):
    rnd = random.Random(5)
    a = [(float(rnd.gauss(0, 1)),) for _ in range(500)]
    b = [(float(rnd.gauss(0.5, 1)),) for _ in range(400)]
    da, db = spark.createDataFrame(a, "v double"), spark.createDataFrame(b, "v double")
    same = drift.binned_divergence(da, da, "v").first()
    assert same["psi"] == 0.0 and same["js"] == 0.0
    ks = drift.ks_statistic(da, db, "v", buckets=8).first()["ks"]
    xs = sorted(set(x for (x,) in a) | set(x for (x,) in b))
    sa, sb = sorted(x for (x,) in a), sorted(x for (x,) in b)
    import bisect
    want = max(abs(bisect.bisect_right(sa, x) / len(sa) - bisect.bisect_right(sb, x) / len(sb)) for x in xs)
    assert math.isclose(ks, round(want, 6), abs_tol=1e-6)
    shifted = drift.binned_divergence(da, db, "v").first()
    assert shifted["psi"] > 0.05 and shifted["js"] > 0
