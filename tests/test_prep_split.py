from pyspark.sql import functions as F

from keelson.operators import prep, split
from keelson.operators.prep import PrepSpec
from tests.conftest import rows

RAW_SCHEMA = ("PageID long, `Height (m)` double, `Weight (kg)` double, Universe string, Teams string, "
              "Origin string, Identity string, Gender string, `Marital Status` string, Alive string")


def _raw(spark):
    data = [
        (1, 1.8, 80.0, "Earth-616", "X", "Human", "Public", "Male", "Single", "Alive"),
        (2, 1.7, 70.0, "Earth-616", None, "Inhuman", "Secret", "Female", "Widow", "Dead"),
        (3, 1.6, 60.0, None, None, "Mutant", "Secret", "Agender", "Married", "Alive"),
        (4, 1.5, 50.0, "Earth-1", "Y", None, "No Dual", "Male", "Single", "Alive"),
        (5, 1.5, 50.0, "Earth-1", "Y", "magic god", None, None, None, "Alive"),
        (6, 1.5, 50.0, "Earth-1", "Y", "Robot", "Public", "Male", "Divorced", "Alive"),
        (7, 1.5, 50.0, "Earth-1", "Y", "Robot", "Public", "Male", "Single", None),
    ]
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_feature_prep_order_and_rules(spark):
    spec = PrepSpec(min_count=2)
    out = prep.feature_prep(_raw(spark), spec)
    assert out.columns == ["Height", "Weight", "Universe", "Identity", "Gender", "Marital_Status",
                           "Teams", "Origin", "Magic", "Mutant", "Alive", "Id"]
    got = {r["Id"]: r for r in out.collect()}
    # 4: identity not allowed; 6: marital not allowed; 7: null target -> dropped
    assert sorted(got) == ["1", "2", "3", "5"]
    # rare fold counts ALL rows (Earth-1 has 4 rows before any filter); null -> Unknown (1 row) -> Other
    assert got["1"]["Universe"] == "Earth-616" and got["5"]["Universe"] == "Earth-1"
    assert got["3"]["Universe"] == "Other"
    assert got["2"]["Origin"] == "Human"               # contains-test: Inhuman -> Human
    assert got["2"]["Marital_Status"] == "Widowed"
    assert got["3"]["Gender"] == "Other" and got["5"]["Gender"] == "Other"
    assert got["5"]["Identity"] == "Unknown" and got["5"]["Marital_Status"] == "Unknown"
    assert (got["5"]["Magic"], got["3"]["Mutant"], got["1"]["Teams"], got["2"]["Teams"]) == (1, 1, 1, 0)
    assert got["2"]["Alive"] == 0 and got["1"]["Alive"] == 1


def test_fold_rare_keeps_nulls_and_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    out = rows(prep.fold_rare(df, "c", 2), "c")
    assert out == [("Other",), ("a",), ("a",), (None,)]


def test_split_disjoint_exhaustive_repartition_invariant(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = split.assign_split(df, "k", 0.2, 42)
    b = split.assign_split(df.repartition(13), "k", 0.2, 42)
    assert sorted(a.collect()) == sorted(b.collect())
    tr, te = split.split_frames(df, "k", 0.2, 42)
    assert tr.count() + te.count() == 5000
    assert tr.join(te, "k").count() == 0
    assert 850 < te.count() < 1150


def test_exact_split_size(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = split.assign_split_exact(df, "k", 201, 42)
    assert s.where(F.col("split") == "test").count() == 201
    assert s.count() == 1003
