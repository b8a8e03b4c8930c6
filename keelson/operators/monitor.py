"""Served payloads -> monitoring rows, and windowed profiles over them.

Plan shape of ``flatten_payload``: Scan -> Project(from_json x2) ->
Generate(posexplode) -> Project.  No shuffle at all: it is a narrow,
per-row transformation and scales linearly with the payload table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.columns import epoch_ms

__all__ = [
    "flatten_payload", "prediction_fallback", "stage_counts", "parse_payload", "parse_records",
    "window_profile", "window_drift",
]


def parse_payload(payload: DataFrame, request_schema: T.StructType, response_schema: T.StructType,
                  request_col: str = "request", response_col: str = "response") -> DataFrame:
    """Parse request / response JSON text (PERMISSIVE: bad JSON -> null fields)."""
    return (payload
            .withColumn("parsed_request", F.from_json(F.col(request_col), request_schema))
            .withColumn("parsed_response", F.from_json(F.col(response_col), response_schema)))


def parse_records(payload: DataFrame, fields: Sequence[tuple[str, str]], *, keep: Sequence[str] = (),
                  records_field: str = "dataframe_records", predictions_field: str = "predictions",
                  request_col: str = "request", response_col: str = "response") -> tuple[DataFrame, DataFrame]:
    """Typed records and those that don't fit: (good, rejected).

    JSON is parsed once into variants, so a number in a string or a prediction
    like ``1.0`` is read as what it means, and one bad field costs its record, not
    the request.  ``good`` has ``keep``, pos, the fields and prediction (null where
    there is none); ``rejected`` has ``keep``, pos, reason and the record as text.  A
    request that is no JSON or has no list of records is one rejected row with a null
    pos.  Every record is in one of the two; an empty list has none."""
    request, response = F.try_parse_json(request_col), F.try_parse_json(response_col)
    parsed = payload.select(*keep, F.col(request_col).alias("__text"), request.alias("__request"),
                            F.try_variant_get(response, f"$.{predictions_field}", "array<variant>").alias("__predictions"))
    parsed = parsed.withColumn("__records", F.try_variant_get("__request", f"$.{records_field}", "array<variant>"))
    broken = parsed.where(F.col("__records").isNull()).select(
        *keep, F.lit(None).cast("int").alias("pos"),
        F.when(F.col("__request").isNull(), F.lit("request is not JSON")).otherwise(F.lit("no list of records")).alias("reason"),
        F.col("__text").alias("record"))
    rows = parsed.select(*keep, "__predictions", F.posexplode("__records").alias("pos", "__record"))
    typed = {name: F.try_variant_get("__record", f"$.{name}", kind) for name, kind in fields}
    given = {name: F.try_variant_get("__record", f"$.{name}", "variant") for name, _ in fields}
    score = F.get("__predictions", F.col("pos"))
    number = F.try_variant_get(score, "$", "double")
    rows = rows.withColumns({f"__t_{n}": c for n, c in typed.items()} | {f"__g_{n}": c for n, c in given.items()}
                            | {"__score": score, "__number": number})

    def there(c: Column) -> Column:
        return c.isNotNull() & ~F.is_variant_null(c)

    reason = F.when(~F.coalesce(F.schema_of_variant("__record").startswith("OBJECT"), F.lit(False)), F.lit("record is not an object"))
    for name, kind in fields:
        reason = reason.when(there(F.col(f"__g_{name}")) & F.col(f"__t_{name}").isNull(), F.lit(f"{name} is not {kind}"))
    whole = F.col("__number").cast("int") == F.col("__number")
    reason = reason.when(there(F.col("__score")) & ~F.coalesce(whole, F.lit(False)), F.lit("prediction is not a whole number"))
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").select(*keep, "pos", *[F.col(f"__t_{n}").alias(n) for n, _ in fields],
                                                 F.col("__number").cast("int").alias("prediction"))
    bad = judged.where("reason is not null").select(*keep, "pos", "reason", F.to_json("__record").alias("record"))
    return good, bad.unionByName(broken)


def flatten_payload(payload: DataFrame, request_schema: T.StructType, response_schema: T.StructType,
                    *, records_field: str = "dataframe_records", predictions_field: str = "predictions",
                    time_col: str = "request_time", passthrough: Sequence[str] = (),
                    record_fields: Sequence[str] | None = None, align: str = "position",
                    model_name: str | Column = "model", keep_pos: bool = False,
                    request_col: str = "request", response_col: str = "response") -> DataFrame:
    """One output row per record of each request.

    ``align="position"`` gives record *i* the *i*-th prediction; ``align="first"``
    gives every record the first prediction (the behaviour of the original
    job).  Requests whose record list is null or empty produce no rows.
    Missing predictions (bad JSON, short list) are null, never an error:
    ``get`` is used instead of ``[]`` because ANSI mode raises on ``[]``.
    """
    if align not in ("position", "first"):
        raise ValueError("align must be 'position' or 'first'")
    parsed = parse_payload(payload, request_schema, response_schema, request_col, response_col)
    exploded = parsed.select(
        "*", F.posexplode(F.col(f"parsed_request.{records_field}")).alias("pos", "record"))
    rec_type = request_schema[records_field].dataType.elementType
    fields = list(record_fields) if record_fields is not None else [f.name for f in rec_type.fields]
    preds = F.col(f"parsed_response.{predictions_field}")
    index = F.col("pos") if align == "position" else F.lit(0)
    model = F.lit(model_name) if isinstance(model_name, str) else model_name
    cols = [F.col(time_col).alias("timestamp"), epoch_ms(F.col(time_col)).alias("timestamp_ms")]
    cols += [F.col(c) for c in passthrough]
    if keep_pos:
        cols.append(F.col("pos"))
    cols += [F.col(f"record.{f}").alias(f) for f in fields]
    cols += [F.get(preds, index).cast("int").alias("prediction"), model.alias("model_name")]
    return exploded.select(*cols)


def prediction_fallback(df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    """Keep rows with a prediction; if *no* row has one, keep every row.

    The "any valid row?" flag is a scalar subquery with ``LIMIT 1``: Spark
    runs it once, scanning partitions incrementally and stopping at the first
    row with a prediction, and inlines the value -- no cross join, no global
    window, no second full pass when valid rows exist."""
    probe = df.where(F.col(pred_col).isNotNull()).select(F.lit(True).alias("v")).limit(1)
    any_valid = F.coalesce(probe.scalar(), F.lit(False))
    return df.filter(F.col(pred_col).isNotNull() | ~any_valid)


def stage_counts(payload: DataFrame, request_schema: T.StructType, response_schema: T.StructType,
                 *, records_field: str = "dataframe_records", predictions_field: str = "predictions",
                 align: str = "position", request_col: str = "request",
                 response_col: str = "response") -> DataFrame:
    """Row counts at every stage of the monitoring refresh in ONE pass.

    ``posexplode_outer`` keeps requests without records as a single row with a
    null position, so one aggregation yields: requests, records, records with a
    prediction and the number of rows the fallback rule would write."""
    parsed = parse_payload(payload, request_schema, response_schema, request_col, response_col)
    ex = parsed.select(
        F.posexplode_outer(F.col(f"parsed_request.{records_field}")).alias("pos", "record"),
        F.col(f"parsed_response.{predictions_field}").alias("preds"))
    index = F.col("pos") if align == "position" else F.lit(0)
    has_rec = F.col("pos").isNotNull()
    valid = has_rec & F.get(F.col("preds"), index).isNotNull()
    agg = ex.agg(
        F.count_if(~has_rec | (F.col("pos") == 0)).alias("n_requests"),
        F.count_if(~has_rec).alias("n_requests_without_records"),
        F.count_if(has_rec).alias("n_records"),
        F.count_if(valid).alias("n_valid"),
    )
    return agg.select(
        "n_requests", "n_requests_without_records", "n_records", "n_valid",
        F.when(F.col("n_valid") > 0, F.col("n_valid")).otherwise(F.col("n_records")).alias("n_written"),
    )


def window_profile(mon: DataFrame, *, ts_col: str = "timestamp", model_col: str = "model_name",
                   pred_col: str = "prediction", feature_cols: Sequence[str] = (),
                   granularity: str = "30 minutes", decimals: int = 6) -> DataFrame:
    """Tumbling-window profile per model: counts, null counts, feature moments,
    prediction distribution.

    A plain hash aggregate on (window, model): partial aggregation runs
    map-side, so a hot model or a hot window only sends one partial row per
    task through the shuffle."""
    w = F.window(F.col(ts_col), granularity)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(pred_col).isNull()).alias("n_null_prediction"),
        F.count_if(F.col(pred_col) == 1).alias("n_pred_1"),
        F.count_if(F.col(pred_col) == 0).alias("n_pred_0"),
    ]
    for c in feature_cols:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"n_null_{c}"),
            F.round(F.avg(c), decimals).alias(f"mean_{c}"),
            F.round(F.stddev_samp(c), decimals).alias(f"std_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
        ]
    out = mon.groupBy(w.alias("w"), F.col(model_col)).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      F.col(model_col), *[c for c in out.columns if c not in ("w", model_col)])


def window_drift(profile: DataFrame, *, model_col: str = "model_name", feature: str,
                 granularity_minutes: int = 30, decimals: int = 6) -> DataFrame:
    """Each window against the window immediately before it (same model).

    Implemented as an equi-join of the profile with itself shifted by one
    window length -- no ordered window over a model partition, so a model with
    years of history is still spread over many tasks."""
    mean_c, n = f"mean_{feature}", "n_rows"
    cur = profile.select(model_col, "window_start", n, mean_c, "n_pred_1",
                         (F.col("n_pred_1") / F.col(n)).alias("pos_rate"))
    prev = profile.select(
        F.col(model_col),
        (F.col("window_start") + F.expr(f"INTERVAL {granularity_minutes} MINUTES")).alias("window_start"),
        F.col(n).alias("prev_n_rows"), F.col(mean_c).alias(f"prev_{mean_c}"),
        (F.col("n_pred_1") / F.col(n)).alias("prev_pos_rate"))
    j = cur.join(prev, [model_col, "window_start"], "left")
    return j.select(
        model_col, "window_start", n, "prev_n_rows", mean_c, f"prev_{mean_c}",
        F.round(F.col(mean_c) - F.col(f"prev_{mean_c}"), decimals).alias("mean_shift"),
        F.round("pos_rate", decimals).alias("pos_rate"),
        F.round("prev_pos_rate", decimals).alias("prev_pos_rate"),
        F.round(F.col("pos_rate") - F.col("prev_pos_rate"), decimals).alias("pos_rate_shift"),
    )
