from pyspark.sql import types as T

from keelson.operators import monitor
from tests.conftest import rows

REC = T.StructType([T.StructField("h", T.DoubleType()), T.StructField("u", T.StringType())])
REQ = T.StructType([T.StructField("dataframe_records", T.ArrayType(REC))])
RESP = T.StructType([T.StructField("predictions", T.ArrayType(T.IntegerType()))])


def _payload(spark, data):
    return spark.createDataFrame(data, "request_time string, rid string, request string, response string")


def test_flatten_align_modes_and_bad_json(spark):
    p = _payload(spark, [
        ("2024-01-01 00:00:01", "a", '{"dataframe_records": [{"h": 1.0, "u": "x"}, {"h": 2.0, "u": "y"}]}',
         '{"predictions": [1, 0]}'),
        ("2024-01-01 00:00:02", "b", '{"dataframe_records": [{"h": 3.0, "u": "z"}]}', '{"predictions": ['),
        ("2024-01-01 00:00:03", "c", '{"dataframe_records": []}', '{"predictions": [1]}'),
        ("2024-01-01 00:00:04", "d", "not json", '{"predictions": [1]}'),
        ("2024-01-01 00:00:05", "e", '{"dataframe_records": [{"h": 4.0, "u": "w"}]}',
         '{"predictions": [1.0]}'),
    ]).selectExpr("cast(request_time as timestamp) request_time", "rid", "request", "response")
    pos = monitor.flatten_payload(p, REQ, RESP, align="position", passthrough=["rid"], model_name="m")
    first = monitor.flatten_payload(p, REQ, RESP, align="first", passthrough=["rid"], model_name="m")
    assert rows(pos, "rid", "h", "prediction") == [("a", 1.0, 1), ("a", 2.0, 0), ("b", 3.0, None), ("e", 4.0, None)]
    assert rows(first, "rid", "h", "prediction") == [("a", 1.0, 1), ("a", 2.0, 1), ("b", 3.0, None), ("e", 4.0, None)]
    assert pos.select("timestamp_ms").first()[0] % 1000 == 0
    kept = monitor.prediction_fallback(pos)
    assert rows(kept, "rid", "h") == [("a", 1.0), ("a", 2.0)]
    counts = monitor.stage_counts(p, REQ, RESP).first().asDict()
    assert counts == {"n_requests": 5, "n_requests_without_records": 2, "n_records": 4, "n_valid": 2,
                      "n_written": 2}


def test_fallback_keeps_all_when_none_valid(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, prediction int")
    assert monitor.prediction_fallback(df).count() == 2
    empty = df.where("id > 5")
    assert monitor.prediction_fallback(empty).count() == 0


def test_window_profile_and_drift(spark):
    df = spark.createDataFrame([
        ("2024-01-01 00:05:00", "m", 1.0, 1), ("2024-01-01 00:25:00", "m", 3.0, None),
        ("2024-01-01 00:35:00", "m", 5.0, 0), ("2024-01-01 01:35:00", "m", 7.0, 1),
    ], "t string, model_name string, v double, prediction int").selectExpr(
        "cast(t as timestamp) timestamp", "model_name", "v", "prediction")
    prof = monitor.window_profile(df, feature_cols=["v"])
    got = {str(r["window_start"]): r for r in prof.collect()}
    assert got["2024-01-01 00:00:00"]["n_rows"] == 2
    assert got["2024-01-01 00:00:00"]["n_null_prediction"] == 1
    assert got["2024-01-01 00:00:00"]["mean_v"] == 2.0
    d = {str(r["window_start"]): r for r in monitor.window_drift(prof, feature="v").collect()}
    assert d["2024-01-01 00:30:00"]["mean_shift"] == 3.0
    assert d["2024-01-01 01:30:00"]["prev_n_rows"] is None  # previous bucket empty
