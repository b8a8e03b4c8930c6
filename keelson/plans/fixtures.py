"""Reference-shaped inputs derived from the driver's TPC-H-like tables.

The original jobs read tables that are not shipped (a raw entity CSV, a
serving log, a model registry, an approval sheet, a tenant feed).  Each
function below derives such a table from the given parquet tables with
DataFrame operations only, so every query that uses it scales with the data.
``keelson.plans.oracle_sql`` holds the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.columns import as_utc_timestamp
from keelson.operators.metrics import classification_metrics
from keelson.operators.prep import PrepSpec

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixture constants (shared with the SQL oracle).
REQUEST_BLOCK = 1000          # at most this many records per request (event_id block)
MODEL_NAME = "doc-quality"
DEPLOYED_VERSION = "10"
APPROVAL_BASE_URL = "https://approvals.example.com/approve"
BASELINE_END = "2024-01-16 00:00:00"
CHAMPION_CHARS, CANDIDATE_CHARS = 2000, 1500      # rules of the stored and the new model
TRAINED_CHARS = (4000, 1500, 20000, 1000)         # rules of four runs in turn
ID_BASE = 1700000000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- B1 entity

ENTITY_SPEC = PrepSpec(
    min_count=75,
    identity_keep=("SMALL", "LARGE", "PROMO", "Unknown"),
    gender_keep=("red", "blue"),
    magic_keywords=("ring",),
    mutant_keywords=("anvil", "plate"),
    origin_classes=(("Anvil", ["anvil"]), ("Ring", ["ring"]), ("Bolt", ["bolt"])),
)


def entity_raw(part: DataFrame) -> DataFrame:
    """Raw entity rows shaped like the original CSV (with nulls to clean)."""
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("PageID"),
        F.col("p_retailprice").alias("Height (m)"),
        size.cast("double").alias("Weight (kg)"),
        F.nullif(F.col("p_brand"), F.lit("Brand#4")).alias("Universe"),
        F.when(size % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("x")).alias("Teams"),
        F.nullif(F.col("p_name"), F.lit("red bolt")).alias("Origin"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("Identity"),
        F.nullif(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("hot")).alias("Gender"),
        (F.when(size % 6 == 1, "Single").when(size % 6 == 2, "Married").when(size % 6 == 3, "Widow")
         .when(size % 6 == 4, "Engaged").when(size % 6 == 5, "Divorced")).alias("Marital Status"),
        F.when(size <= 25, "Alive").when(size <= 45, "Dead").alias("Alive"),
    )


# ---------------------------------------------------------------- B2 payloads

RECORD_TYPE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("event_type", T.StringType()),
])
REQUEST_SCHEMA = T.StructType([T.StructField("dataframe_records", T.ArrayType(RECORD_TYPE))])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("predictions", T.ArrayType(T.IntegerType())),
    T.StructField("output", T.StructType([
        T.StructField("trace", T.StringType()),
        T.StructField("request_id", T.StringType()),
    ])),
])


def payload_table(events: DataFrame) -> DataFrame:
    """Serving log: one request per (user, day, event_id block of 1000).

    The block bounds every request to <= 1000 records whatever the skew of
    users, so the collect below never builds an unbounded group."""
    day = F.to_date("ts")
    blk = F.floor(F.col("event_id") / F.lit(REQUEST_BLOCK))
    g = (events.groupBy("user_id", day.alias("day"), blk.alias("blk"))
         .agg(F.min("ts").alias("t0"),
              F.array_sort(F.collect_list(F.struct("event_id", "value", "event_type"))).alias("recs"),
              F.count(F.lit(1)).alias("n")))
    rid = F.concat(F.lit("req-"), F.col("user_id").cast("string"), F.lit("-"),
                   F.date_format("day", "yyyyMMdd"), F.lit("-"), F.col("blk").cast("string"))
    preds = F.transform("recs", lambda r: (r["value"] >= 50).cast("int"))
    good = F.to_json(F.struct(preds.alias("predictions"),
                              F.struct(F.lit(None).cast("string").alias("trace"),
                                       rid.alias("request_id")).alias("output")))
    response = (F.when(F.col("user_id") % 10 == 0, F.lit('{"predictions": ['))
                .when(F.col("user_id") % 10 == 1, F.lit('{"predictions": []}'))
                .otherwise(good))
    return g.select(
        as_utc_timestamp("t0", "timestamp_ntz").alias("request_time"),
        rid.alias("request_id"),
        (F.col("n") * 10 + F.col("user_id") % 7).cast("bigint").alias("execution_duration_ms"),
        F.to_json(F.struct(F.col("recs").alias("dataframe_records"))).alias("request"),
        response.alias("response"),
    )


# ---------------------------------------------------------------- B3 monitoring

def monitoring_table(events: DataFrame) -> DataFrame:
    """Monitoring rows: model = event_type, feature = value, prediction = value>=50
    (null for every 20th user)."""
    return events.select(
        as_utc_timestamp("ts", "timestamp_ntz").alias("timestamp"),
        F.col("event_type").alias("model_name"),
        F.col("value"),
        F.when(F.col("user_id") % 20 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("value") >= 50).cast("int")).alias("prediction"),
    )


def drift_sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = events.where(F.col("ts") < F.lit(BASELINE_END).cast("timestamp_ntz"))
    cur = events.where(F.col("ts") >= F.lit(BASELINE_END).cast("timestamp_ntz"))
    pick = [F.col("event_type").alias("model_name"), F.col("value")]
    return base.select(*pick), cur.select(*pick)


# ---------------------------------------------------------------- B4 runs

def scored_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-document truth / prediction / score; a run is a document source."""
    d = documents.select("doc_id", "source", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    return d.select(
        "doc_id",
        F.col("source").alias("run_id"),
        F.substring("source", 4, 12).cast("int").alias("version_num"),
        F.col("quality").alias("label"),
        (F.col("n_chars") >= 2000).cast("int").alias("prediction"),
        F.col("n_chars").cast("double").alias("score"),
    )


def model_of(run_id: Column) -> Column:
    """Model a run belongs to (runs ``src<N>`` belong to the one fixture model).

    Derived from the data, never a literal: a literal key on both sides of a
    join lets the optimizer fold ``a.model = b.model`` to true and plan a
    cross join."""
    return F.regexp_replace(run_id, r"^src[0-9]+$", MODEL_NAME)


def model_runs(scored: DataFrame) -> DataFrame:
    """Run log: (run_id, start_time, params, metrics map<string,string>).

    accuracy is absent for every 5th version and not a number for version%7=3,
    which exercises the metric fallback rules."""
    m = classification_metrics(scored, group_cols=["run_id", "version_num"], decimals=None)
    v = F.col("version_num")
    acc = (F.when(v % 5 == 0, F.lit(None).cast("string"))
           .when(v % 7 == 3, F.lit("n/a"))
           .otherwise(F.col("accuracy").cast("string")))
    metrics = F.map_filter(
        F.create_map(F.lit("accuracy"), acc,
                     F.lit("f1_score"), F.col("f1").cast("string"),
                     F.lit("precision"), F.col("precision").cast("string"),
                     F.lit("recall"), F.col("recall").cast("string")),
        lambda k, x: x.isNotNull())
    start = (F.lit("2024-02-01 00:00:00").cast("timestamp")
             + F.make_interval(hours=((v * 7) % 20).cast("int")))
    params = F.create_map(F.lit("learning_rate"), F.lit("0.05"), F.lit("n_estimators"), F.lit("200"),
                          F.lit("max_depth"), F.lit("6"))
    return m.select("run_id", "version_num", start.alias("start_time"), params.alias("params"),
                    metrics.alias("metrics"))


def model_versions(runs: DataFrame, max_num: int | None = None) -> DataFrame:
    r = runs if max_num is None else runs.where(F.col("version_num") <= max_num)
    return r.select(model_of(F.col("run_id")).alias("model_name"),
                    F.col("version_num").cast("string").alias("version"),
                    "run_id", F.col("start_time").alias("created_at"))


def model_aliases(versions: DataFrame) -> DataFrame:
    """The serving alias points at version 10 (derived from the versions table)."""
    return (versions.where(F.col("version") == DEPLOYED_VERSION)
            .select("model_name", F.lit("latest-model").alias("alias"), "version"))


def candidates(runs: DataFrame) -> DataFrame:
    return (runs.where(F.col("version_num").cast("string") != DEPLOYED_VERSION)
            .select(F.col("run_id").alias("candidate_run_id"), model_of(F.col("run_id")).alias("model_name"),
                    F.col("version_num").cast("string").alias("model_version")))


# ---------------------------------------------------------------- B5 approvals

def approval_ledger(events: DataFrame) -> DataFrame:
    """Approval sheet rows, one per event: user u acts on run ``src<u>``
    (rows for runs that were never registered simply match nothing)."""
    e = events
    et = F.col("event_type")
    run = F.concat(F.lit("src"), F.col("user_id").cast("string"))
    return e.select(
        run.alias("run_id"),
        model_of(run).alias("model_name"),
        F.col("user_id").cast("string").alias("model_version"),
        F.when(et.isin("click", "view"), F.lit(" true ")).when(et == "error", F.lit("FALSE"))
         .otherwise(F.lit("maybe")).alias("approved_flag"),
        F.when(et == "click", F.lit("APPROVE")).when(et == "error", F.lit("REJECT"))
         .otherwise(F.upper(et)).alias("action"),
        as_utc_timestamp("ts", "timestamp_ntz").alias("updated_on"),
        F.col("event_id").alias("seq"),
    )


# ---------------------------------------------------------------- B6 tenants

def tenant_feed(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("_"))).alias("schema_name"),
        F.col("c_mktsegment").alias("cloud_provider"),
        F.concat(F.lit("/landing/"), k.cast("string")).alias("data_path"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def stored_tenants(customer: DataFrame) -> DataFrame:
    return tenant_feed(customer.where(F.col("c_custkey") % 2 == 1))


def tenant_feed_with_gaps(customer: DataFrame) -> DataFrame:
    """Feed records with missing required fields (every 11th / 13th / 17th key)."""
    k = F.col("customer_id").cast("bigint")
    none = F.lit(None).cast("string")
    return tenant_feed(customer).select(
        "customer_id",
        F.when(k % 11 == 0, none).otherwise(F.col("customer_name")).alias("customer_name"),
        "schema_name",
        F.when(k % 13 == 0, none).otherwise(F.col("cloud_provider")).alias("cloud_provider"),
        F.when(k % 17 == 0, none).otherwise(F.col("data_path")).alias("data_path"),
        "is_active",
    )


def tenant_feed_with_repeats(customer: DataFrame) -> DataFrame:
    """Feed where every 7th customer arrives twice (second copy renamed)."""
    f = tenant_feed(customer).select("customer_id", "customer_name", F.lit(0).alias("seq"))
    again = (customer.where(F.col("c_custkey") % 7 == 0)
             .select(F.col("c_custkey").cast("string").alias("customer_id"),
                     F.upper(F.col("c_name")).alias("customer_name"), F.lit(1).alias("seq")))
    return f.unionByName(again)


def registry_base(customer: DataFrame) -> DataFrame:
    return (stored_tenants(customer)
            .select("customer_id", "customer_name", "is_active",
                    F.lit("1990-01-01 00:00:00").cast("timestamp").alias("updated_on")))


def registry_updates(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        as_utc_timestamp("o_orderdate", "timestamp_ntz").alias("updated_on"),
        F.col("o_orderkey").alias("seq"),
    )


def delete_requests(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Deactivation requests: every 9th customer, plus ids that were never
    onboarded (order keys ending in 7 used as customer ids with a prefix)."""
    known = customer.where(F.col("c_custkey") % 9 == 0).select(F.col("c_custkey").cast("string").alias("customer_id"))
    unknown = orders.where(F.col("o_orderkey") % 10 == 7).select(
        F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("customer_id"))
    return known.unionByName(unknown)


def snapshot_pair(customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    k = F.col("c_custkey")
    old = customer.where(k % 10 != 0).select(*cols)
    new = (customer.where(k % 10 != 1)
           .withColumn("c_acctbal", F.when(k % 10 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
           .select(*cols))
    return old, new


# ---------------------------------------------------------------- B8 landing text

def landing_lines(events: DataFrame) -> DataFrame:
    """Raw text lines as they would land in a tenant folder: JSON records,
    some padded, some truncated (event_id%50=0), some blank (event_id%50=25),
    and every 40th event delivered twice.  Each line belongs to tenant
    ``c<user_id>``."""
    eid = F.col("event_id")
    body = F.concat(F.lit('{"event_id": '), eid.cast("string"),
                    F.lit(', "value_cents": '), F.round(F.col("value") * 100).cast("bigint").cast("string"),
                    F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    line = (F.when(eid % 50 == 0, F.concat(F.lit('{"event_id": '), eid.cast("string"), F.lit(', "value_cents": ')))
            .when(eid % 50 == 25, F.lit("   "))
            .when(eid % 3 == 0, F.concat(F.lit("  "), body, F.lit(" ")))
            .otherwise(body))
    src = F.col("_metadata.file_name")
    tenant = F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("customer_id")
    once = events.select(src.alias("source_file"), line.alias("raw_payload"), tenant)
    twice = events.where(eid % 40 == 0).select(src.alias("source_file"), line.alias("raw_payload"), tenant)
    return once.unionByName(twice)


LANDING_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("value_cents", T.LongType()),
    T.StructField("k", T.IntegerType()),
])


# ------------------------------------------------------------ payloads of entities

# --- fixed values: the ten fields of a served record ---
ENTITY_FIELDS = [("Height", "double"), ("Weight", "double"), ("Universe", "string"), ("Identity", "string"), ("Gender", "string"),
                 ("Marital_Status", "string"), ("Teams", "string"), ("Origin", "string"), ("Magic", "string"), ("Mutant", "string")]
# --- end of fixed values ---


def entity_payloads(part: DataFrame) -> DataFrame:
    """Requests of at most 50 entities: all ten fields, with numbers in strings,
    double predictions, and records, requests and responses that are broken."""
    raw = entity_raw(part)
    key, name = F.col("PageID"), F.col("p_name")
    raw = raw.join(part.select(F.col("p_partkey").alias("PageID"), "p_name"), "PageID")
    texts = F.to_json(F.struct(
        "Universe", "Identity", "Gender", F.col("Marital Status").alias("Marital_Status"), "Teams", "Origin",
        F.when(F.contains(name, F.lit("ring")), "True").otherwise("False").alias("Magic"),
        F.when(F.contains(name, F.lit("anvil")), "True").otherwise("False").alias("Mutant")), {"ignoreNullFields": "false"})
    height = F.col("Height (m)").cast("string")
    height = F.when(key % 13 == 0, F.lit('"tall"')).when(key % 11 == 0, F.concat(F.lit('"'), height, F.lit('"'))).otherwise(height)
    weight = F.when(key % 29 == 0, F.lit("[1]")).otherwise(F.col("Weight (kg)").cast("string"))
    record = F.when(key % 17 == 0, F.lit("5")).otherwise(F.concat(
        F.lit('{"Height":'), height, F.lit(',"Weight":'), weight, F.lit(","), F.substring(texts, F.lit(2), F.length(texts))))
    score = F.when(key % 19 == 0, F.lit("0.5")).when(key % 23 == 0, F.lit('"1"')).otherwise(F.concat((key % 2).cast("string"), F.lit(".0")))
    rows = raw.select(key.alias("id"), F.floor(key / 50).alias("g"), record.alias("record"), score.alias("score"))
    req = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "record", "score"))).alias("r"))   # at most 50

    def listed(field: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[field]), ",")

    request = F.concat(F.lit('{"dataframe_records":['), listed("record"), F.when(F.col("g") % 7 == 6, F.lit("")).otherwise(F.lit("]}")))
    response = F.concat(F.lit('{"predictions":['), listed("score"), F.when(F.col("g") % 5 == 4, F.lit("")).otherwise(F.lit("]}")))
    return req.select(F.concat(F.lit("req-"), F.col("g").cast("string")).alias("request_id"), request.alias("request"),
                      response.alias("response"))


# ------------------------------------------------------------------ lineage

def lineage_tables(orders: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (an order priority each) that read customers' tables, and a graph of
    derivations over customers with diamonds and cycles."""
    inputs = orders.where(F.col("o_orderkey") % 200 == 0).select(F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").alias("node"))
    key = F.col("c_custkey")
    half = customer.where(key > 1).select(key.alias("node"), F.floor(key / 2).alias("source"))
    third = customer.where(key % 3 == 0).select(key.alias("node"), (key / 3).cast("long").alias("source"))
    back = customer.where(key % 8 == 0).select((key / 8).cast("long").alias("node"), key.alias("source"))
    return inputs, half.unionByName(third).unionByName(back)
