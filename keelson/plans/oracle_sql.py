"""DuckDB SQL equal in result to each registered query (tables are views).

The fixture derivations of ``keelson.plans.fixtures`` are restated as CTEs.
Doubles are rounded exactly where the Spark side rounds.
"""

from __future__ import annotations

from keelson.plans.refresh_sql import LATE_ROWS, refresh_sql

ENTITY = """entity AS (
  SELECT p_partkey AS PageID, p_retailprice AS "Height (m)", CAST(p_size AS DOUBLE) AS "Weight (kg)",
         nullif(p_brand, 'Brand#4') AS Universe,
         CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'x' END AS Teams,
         nullif(p_name, 'red bolt') AS Origin,
         nullif(p_type, 'ECONOMY') AS Identity,
         nullif(split_part(p_name, ' ', 1), 'hot') AS Gender,
         CASE p_size % 6 WHEN 1 THEN 'Single' WHEN 2 THEN 'Married' WHEN 3 THEN 'Widow'
                         WHEN 4 THEN 'Engaged' WHEN 5 THEN 'Divorced' END AS "Marital Status",
         CASE WHEN p_size <= 25 THEN 'Alive' WHEN p_size <= 45 THEN 'Dead' END AS Alive
  FROM part)"""

ORIGIN_CLASS = """CASE WHEN contains(lower(O), 'anvil') THEN 'Anvil'
            WHEN contains(lower(O), 'ring') THEN 'Ring'
            WHEN contains(lower(O), 'bolt') THEN 'Bolt' ELSE 'Other' END"""

PAYLOAD = """ev AS (SELECT *, CAST(ts AS DATE) AS day, event_id // 1000 AS blk FROM events),
req AS (SELECT user_id, day, blk, min(ts) AS request_time, count(*) AS n,
               arg_min(value, event_id) AS first_value, min(event_id) AS first_event_id
        FROM ev GROUP BY user_id, day, blk),
recs AS (
  SELECT e.event_id, e.value, e.event_type, e.user_id, r.request_time, r.n, r.first_value, r.first_event_id,
         'req-' || CAST(e.user_id AS VARCHAR) || '-' || strftime(e.day, '%Y%m%d') || '-' || CAST(e.blk AS VARCHAR) AS request_id,
         CAST(r.n * 10 + e.user_id % 7 AS BIGINT) AS execution_duration_ms,
         CAST(row_number() OVER (PARTITION BY e.user_id, e.day, e.blk ORDER BY e.event_id) - 1 AS INTEGER) AS pos,
         e.user_id % 10 IN (0, 1) AS no_pred
  FROM ev e JOIN req r USING (user_id, day, blk))"""

FLAT_FIRST = """SELECT request_time AS "timestamp", CAST(floor(epoch(request_time)) AS BIGINT) * 1000 AS timestamp_ms,
       request_id, execution_duration_ms, event_id, value, event_type,
       CASE WHEN no_pred THEN NULL ELSE CAST(first_value >= 50 AS INTEGER) END AS prediction,
       'events-model' AS model_name
FROM recs"""

FLAT_POS_COLS = """request_time AS "timestamp", CAST(floor(epoch(request_time)) AS BIGINT) * 1000 AS timestamp_ms,
       request_id, execution_duration_ms, event_id, value, event_type,
       CASE WHEN no_pred THEN NULL ELSE CAST(value >= 50 AS INTEGER) END AS prediction,
       'events-model' AS model_name"""

MONITOR = """m AS (SELECT ts AS "timestamp", event_type AS model_name, value,
                  CASE WHEN user_id % 20 = 0 THEN NULL ELSE CAST(value >= 50 AS INTEGER) END AS prediction
           FROM events),
p AS (SELECT time_bucket(INTERVAL 30 MINUTE, "timestamp") AS window_start,
             time_bucket(INTERVAL 30 MINUTE, "timestamp") + INTERVAL 30 MINUTE AS window_end,
             model_name, count(*) AS n_rows,
             count(*) FILTER (WHERE prediction IS NULL) AS n_null_prediction,
             count(*) FILTER (WHERE prediction = 1) AS n_pred_1,
             count(*) FILTER (WHERE prediction = 0) AS n_pred_0,
             count(*) FILTER (WHERE value IS NULL) AS n_null_value,
             round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value,
             min(value) AS min_value, max(value) AS max_value
      FROM m GROUP BY ALL)"""

SIDES = """b AS (SELECT event_type AS model_name, value FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
c AS (SELECT event_type AS model_name, value FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')"""

BINNED = SIDES + """,
rng AS (SELECT model_name, min(value) AS lo, max(value) AS hi FROM b GROUP BY model_name),
grid AS (SELECT model_name, CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM rng),
bb AS (SELECT model_name, CAST(CASE WHEN hi > lo THEN least(greatest(floor((value - lo) / ((hi - lo) / 10.0::DOUBLE)), 0), 9) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
       FROM b JOIN rng USING (model_name) GROUP BY ALL),
cc AS (SELECT model_name, CAST(CASE WHEN hi > lo THEN least(greatest(floor((value - lo) / ((hi - lo) / 10.0::DOUBLE)), 0), 9) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
       FROM c JOIN rng USING (model_name) GROUP BY ALL),
tb AS (SELECT model_name, count(*) AS nb FROM b GROUP BY model_name),
tc AS (SELECT model_name, count(*) AS nc FROM c GROUP BY model_name),
j AS (SELECT g.model_name, g.bin, tb.nb, tc.nc,
             greatest(coalesce(bb.n, 0) / tb.nb, 1e-6::DOUBLE) AS p,
             greatest(coalesce(cc.n, 0) / tc.nc, 1e-6::DOUBLE) AS q
      FROM grid g LEFT JOIN bb ON bb.model_name = g.model_name AND bb.bin = g.bin
                  LEFT JOIN cc ON cc.model_name = g.model_name AND cc.bin = g.bin
                  LEFT JOIN tb ON tb.model_name = g.model_name
                  LEFT JOIN tc ON tc.model_name = g.model_name)"""

SCORED = """scored AS (
  SELECT d.doc_id, d.source AS run_id, CAST(substr(d.source, 4, 12) AS INTEGER) AS version_num,
         l.quality AS label, CAST(d.n_chars >= 2000 AS INTEGER) AS prediction, CAST(d.n_chars AS DOUBLE) AS score
  FROM documents d JOIN labels l USING (doc_id)),
cm AS (SELECT run_id, version_num,
              count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn,
              count(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn
       FROM scored GROUP BY run_id, version_num),
mt AS (SELECT *,
              CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END AS accuracy,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS "precision",
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
              TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST((version_num * 7) % 20 AS BIGINT)) AS start_time
       FROM cm),
dep AS (SELECT run_id AS drun, f1 AS df1 FROM mt WHERE version_num = 10)"""

LEDGER = """led AS (
  SELECT 'src' || CAST(user_id AS VARCHAR) AS run_id, 'doc-quality' AS model_name,
         CAST(user_id AS VARCHAR) AS model_version,
         CASE WHEN event_type IN ('click', 'view') THEN ' true ' WHEN event_type = 'error' THEN 'FALSE' ELSE 'maybe' END AS approved_flag,
         CASE WHEN event_type = 'click' THEN 'APPROVE' WHEN event_type = 'error' THEN 'REJECT' ELSE upper(event_type) END AS action,
         ts AS updated_on, event_id AS seq
  FROM events),
lastled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_on DESC, seq DESC) AS rn FROM led) WHERE rn = 1),
appr AS (SELECT m.run_id, 'doc-quality' AS model_name, CAST(m.version_num AS VARCHAR) AS model_version,
                upper(trim(l.approved_flag)) AS flag,
                CASE upper(trim(l.approved_flag)) WHEN 'TRUE' THEN 'APPROVED' WHEN 'FALSE' THEN 'REJECTED' ELSE 'PENDING' END AS decision
         FROM mt m LEFT JOIN lastled l ON l.run_id = m.run_id WHERE m.version_num <> 10)"""

GATE = """gate AS (SELECT m.run_id AS candidate_run_id, 'doc-quality' AS model_name, '10' AS deployed_version,
                 dep.drun AS deployed_run_id, 'f1_score' AS metric_name,
                 round(m.f1, 6) AS candidate_metric, round(dep.df1, 6) AS deployed_metric,
                 m.f1 > dep.df1 AS better, NOT (m.f1 > dep.df1) AS skip_deploy
          FROM mt m CROSS JOIN dep WHERE m.version_num <> 10)"""

FEED = """feed AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
                 lower(replace(c_name, '#', '_')) AS schema_name, c_mktsegment AS cloud_provider,
                 '/landing/' || CAST(c_custkey AS VARCHAR) AS data_path, c_acctbal > 0 AS is_active, c_custkey
          FROM customer),
stored AS (SELECT customer_id FROM feed WHERE c_custkey % 2 = 1)"""

SNAP = """old AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
new AS (SELECT c_custkey, c_name, c_nationkey,
               CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
        FROM customer WHERE c_custkey % 10 <> 1)"""

SPLIT = """s AS (SELECT c_custkey, (('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '#42'), 1, 8))::BIGINT) % 10000 AS bucket
      FROM customer)"""

LANDING = """ln AS (
  SELECT 'events.parquet' AS source_file, event_id,
         CASE WHEN event_id % 50 = 0 THEN '{"event_id": ' || CAST(event_id AS VARCHAR) || ', "value_cents": '
              WHEN event_id % 50 = 25 THEN '   '
              WHEN event_id % 3 = 0 THEN '  ' || body || ' '
              ELSE body END AS raw_payload
  FROM (SELECT *, '{"event_id": ' || CAST(event_id AS VARCHAR) || ', "value_cents": '
                  || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ', "k": '
                  || json_extract_string(props, '$.k') || '}' AS body FROM events)),
bronze AS (SELECT source_file, raw_payload FROM ln
           UNION ALL SELECT source_file, raw_payload FROM ln WHERE event_id % 40 = 0),
silver AS (SELECT sha256(cp) AS record_id, cp AS clean_payload
           FROM (SELECT DISTINCT trim(raw_payload) AS cp FROM bronze)
           WHERE cp <> '' AND json_valid(cp)
             AND json_extract(cp, '$.event_id') IS NOT NULL
             AND json_extract(cp, '$.value_cents') IS NOT NULL
             AND json_extract(cp, '$.k') IS NOT NULL)"""


def _u(key: str, salt: str) -> str:
    return f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT) / CAST(4294967296 AS DOUBLE))"


def _u_open(key: str, salt: str) -> str:
    return (f"(((('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT) + 1)"
            f" / CAST(4294967297 AS DOUBLE))")


SYNTH_NUM = f"""prof AS (SELECT avg(c_acctbal) AS mu, stddev_samp(c_acctbal) AS sd FROM customer),
syn AS (SELECT c_custkey, CAST(1700000000000 + c_custkey AS VARCHAR) AS Id,
               greatest(0.1::DOUBLE, mu + sd * (sqrt(-2.0::DOUBLE * ln({_u_open('c_custkey', '#42a')}))
                                      * cos(2 * pi() * {_u('c_custkey', '#42b')}))) AS x
        FROM customer CROSS JOIN prof)"""

CAT_MAP = """SELECT {key}, {col}, CAST(coalesce(mp.code, -1) AS INTEGER) AS {col}_code
FROM {table} LEFT JOIN (
  SELECT {col} AS mcol, CAST(row_number() OVER (ORDER BY {col}) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT {col} FROM {table} WHERE {col} IS NOT NULL {fit_filter})) mp ON mp.mcol = {table}.{col}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # ---- B1 feature prep
    q["rename_project"] = f"""WITH {ENTITY}
SELECT CAST(PageID AS VARCHAR) AS Id, "Height (m)" AS Height, "Weight (kg)" AS Weight, Universe,
       "Marital Status" AS Marital_Status FROM entity"""
    q["membership_filter"] = f"""WITH {ENTITY}
SELECT PageID, coalesce(Identity, 'Unknown') AS Identity FROM entity
WHERE coalesce(Identity, 'Unknown') IN ('SMALL', 'LARGE', 'PROMO', 'Unknown')"""
    q["null_fill"] = f"""WITH {ENTITY}
SELECT PageID, coalesce(Universe, 'Unknown') AS Universe, coalesce(Origin, 'Unknown') AS Origin,
       coalesce(Identity, 'Unknown') AS Identity, coalesce(Gender, 'Unknown') AS Gender,
       coalesce("Marital Status", 'Unknown') AS Marital_Status FROM entity"""
    q["rare_fold"] = f"""WITH {ENTITY},
u AS (SELECT PageID, coalesce(Universe, 'Unknown') AS Universe FROM entity),
c AS (SELECT Universe, count(*) AS n FROM u GROUP BY Universe)
SELECT u.PageID, CASE WHEN c.n < 75 THEN 'Other' ELSE u.Universe END AS Universe FROM u JOIN c USING (Universe)"""
    q["presence_flag"] = f"""WITH {ENTITY}
SELECT PageID, CAST(Teams IS NOT NULL AS INTEGER) AS Teams FROM entity"""
    q["value_map"] = f"""WITH {ENTITY}
SELECT PageID,
       CASE WHEN coalesce(Gender, 'Unknown') IN ('red', 'blue') THEN coalesce(Gender, 'Unknown') ELSE 'Other' END AS Gender,
       CASE WHEN coalesce("Marital Status", 'Unknown') = 'Widow' THEN 'Widowed' ELSE coalesce("Marital Status", 'Unknown') END AS Marital_Status
FROM entity"""
    q["keyword_flags"] = f"""WITH {ENTITY}, o AS (SELECT PageID, lower(coalesce(Origin, 'Unknown')) AS O FROM entity)
SELECT PageID, CAST(contains(O, 'ring') AS INTEGER) AS Magic,
       CAST(contains(O, 'anvil') OR contains(O, 'plate') AS INTEGER) AS Mutant FROM o"""
    q["priority_classify"] = f"""WITH {ENTITY}, o AS (SELECT PageID, coalesce(Origin, 'Unknown') AS O FROM entity)
SELECT PageID, {ORIGIN_CLASS} AS Origin FROM o"""
    q["binary_target"] = f"""WITH {ENTITY}
SELECT PageID, CAST(Alive = 'Alive' AS INTEGER) AS Alive FROM entity WHERE Alive IN ('Alive', 'Dead')"""
    q["csv_scan"] = f"WITH {ENTITY}\nSELECT * FROM entity"
    q["json_feed"] = f"""WITH {FEED}
SELECT customer_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE customer_name END AS customer_name, schema_name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cloud_provider END AS cloud_provider,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE data_path END AS data_path, is_active FROM feed"""
    q["feature_prep"] = f"""WITH {ENTITY},
s1 AS (SELECT *, coalesce(Universe, 'Unknown') AS U FROM entity),
c AS (SELECT U, count(*) AS n FROM s1 GROUP BY U),
s2 AS (SELECT s1.*, CASE WHEN c.n < 75 THEN 'Other' ELSE s1.U END AS U2,
              coalesce(Identity, 'Unknown') AS I, coalesce(Origin, 'Unknown') AS O,
              CASE WHEN coalesce("Marital Status", 'Unknown') = 'Widow' THEN 'Widowed'
                   ELSE coalesce("Marital Status", 'Unknown') END AS M,
              coalesce(Gender, 'Unknown') AS G
       FROM s1 JOIN c USING (U))
SELECT "Height (m)" AS Height, "Weight (kg)" AS Weight, U2 AS Universe, I AS Identity,
       CASE WHEN G IN ('red', 'blue') THEN G ELSE 'Other' END AS Gender, M AS Marital_Status,
       CAST(Teams IS NOT NULL AS INTEGER) AS Teams, {ORIGIN_CLASS} AS Origin,
       CAST(contains(lower(O), 'ring') AS INTEGER) AS Magic,
       CAST(contains(lower(O), 'anvil') OR contains(lower(O), 'plate') AS INTEGER) AS Mutant,
       CAST(Alive = 'Alive' AS INTEGER) AS Alive, CAST(PageID AS VARCHAR) AS Id
FROM s2
WHERE I IN ('SMALL', 'LARGE', 'PROMO', 'Unknown')
  AND M IN ('Single', 'Married', 'Widowed', 'Engaged', 'Unknown')
  AND Alive IN ('Alive', 'Dead')"""

    # ---- B2 payloads
    q["payload_flatten"] = f"WITH {PAYLOAD}\n{FLAT_FIRST}"
    q["payload_flatten_pos"] = f"WITH {PAYLOAD}\nSELECT pos, {FLAT_POS_COLS} FROM recs"
    q["prediction_fallback"] = f"""WITH {PAYLOAD}, f AS (SELECT {FLAT_POS_COLS} FROM recs)
SELECT * FROM f WHERE prediction IS NOT NULL OR NOT EXISTS (SELECT 1 FROM f WHERE prediction IS NOT NULL)"""
    q["stage_counts"] = f"""WITH {PAYLOAD},
a AS (SELECT (SELECT count(*) FROM req) AS n_requests, CAST(0 AS BIGINT) AS n_requests_without_records,
             count(*) AS n_records, count(*) FILTER (WHERE NOT no_pred) AS n_valid FROM recs)
SELECT *, CASE WHEN n_valid > 0 THEN n_valid ELSE n_records END AS n_written FROM a"""
    q["epoch_ms"] = f"""WITH {PAYLOAD}
SELECT DISTINCT request_id, request_time AS "timestamp",
       CAST(floor(epoch(request_time)) AS BIGINT) * 1000 AS timestamp_ms FROM recs"""
    q["json_parse"] = f"""WITH {PAYLOAD}
SELECT DISTINCT request_id, CAST(n AS INTEGER) AS n_records, first_event_id,
       CAST(CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN 0 ELSE n END AS INTEGER) AS n_predictions,
       CASE WHEN no_pred THEN NULL ELSE CAST(first_value >= 50 AS INTEGER) END AS first_prediction,
       CASE WHEN no_pred THEN NULL ELSE request_id END AS echo_request_id
FROM recs"""
    q["label_decode"] = f"""WITH {PAYLOAD}, f AS (SELECT {FLAT_POS_COLS} FROM recs)
SELECT request_id, event_id, prediction, CASE WHEN prediction = 1 THEN 'alive' ELSE 'dead' END AS label FROM f"""

    # ---- B3 monitoring / drift
    q["window_profile"] = f"WITH {MONITOR}\nSELECT * FROM p"
    q["window_drift"] = f"""WITH {MONITOR},
cur AS (SELECT model_name, window_start, n_rows, mean_value, n_pred_1 / n_rows AS pos_rate FROM p)
SELECT c.model_name, c.window_start, c.n_rows, pr.n_rows AS prev_n_rows, c.mean_value,
       pr.mean_value AS prev_mean_value, round(c.mean_value - pr.mean_value, 6) AS mean_shift,
       round(c.pos_rate, 6) AS pos_rate, round(pr.pos_rate, 6) AS prev_pos_rate,
       round(c.pos_rate - pr.pos_rate, 6) AS pos_rate_shift
FROM cur c LEFT JOIN cur pr ON pr.model_name = c.model_name AND pr.window_start + INTERVAL 30 MINUTE = c.window_start"""
    q.update(refresh_sql(q["window_profile"], ENTITY, SCORED, FEED))
    q["drift_psi"] = f"""WITH {BINNED}
SELECT model_name, any_value(nb) AS n_baseline, any_value(nc) AS n_current,
       round(sum((q - p) * ln(q / p)), 6) AS psi FROM j GROUP BY model_name"""
    q["drift_js"] = f"""WITH {BINNED}
SELECT model_name, any_value(nb) AS n_baseline, any_value(nc) AS n_current,
       round(sum(0.5 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 6) AS js
FROM j GROUP BY model_name"""
    q["drift_ks"] = f"""WITH {SIDES},
pv AS (SELECT model_name, value, sum(nb) AS nb, sum(nc) AS nc
       FROM (SELECT model_name, value, 1 AS nb, 0 AS nc FROM b WHERE value IS NOT NULL
             UNION ALL SELECT model_name, value, 0, 1 FROM c WHERE value IS NOT NULL) GROUP BY ALL),
cum AS (SELECT *, sum(nb) OVER (PARTITION BY model_name ORDER BY value) AS cb,
               sum(nc) OVER (PARTITION BY model_name ORDER BY value) AS ccum,
               sum(nb) OVER (PARTITION BY model_name) AS tb, sum(nc) OVER (PARTITION BY model_name) AS tc FROM pv)
SELECT model_name, CAST(max(tb) AS BIGINT) AS n_baseline, CAST(max(tc) AS BIGINT) AS n_current,
       round(max(abs(cb / tb - ccum / tc)), 6) AS ks
FROM cum WHERE tb > 0 AND tc > 0 GROUP BY model_name"""

    # ---- B4 runs / gates
    q["classification_metrics"] = f"""WITH {SCORED}
SELECT run_id, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mt"""
    q["confusion_matrix"] = f"""WITH {SCORED}
SELECT run_id, label AS actual, prediction AS predicted, count(*) AS n FROM scored GROUP BY ALL"""
    q["auc_rank"] = f"""WITH {SCORED},
ps AS (SELECT run_id, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM scored WHERE score IS NOT NULL AND label IN (0, 1) GROUP BY ALL),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY run_id ORDER BY score) AS cneg FROM ps)
SELECT run_id, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(CASE WHEN sum(pos) * sum(neg) > 0
                  THEN sum(pos * (cneg - neg + neg * 0.5::DOUBLE)) / (sum(pos) * sum(neg)) END, 6) AS auc
FROM cu GROUP BY run_id"""
    q["log_loss"] = f"""WITH {SCORED}, pr AS (SELECT run_id, label,
       least(greatest(score / (score + 2000.0::DOUBLE), 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS p FROM scored)
SELECT run_id, count(*) AS n, round(avg(-(label * ln(p) + (1.0::DOUBLE - label) * ln(1.0::DOUBLE - p))), 6) AS log_loss
FROM pr GROUP BY run_id"""
    q["run_names"] = f"""WITH {SCORED}
SELECT run_id, 'wrapper-gbt-' || strftime(start_time, '%Y-%m-%d') AS run_name,
       strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') AS created_at_text FROM mt"""
    q["eval_bundle"] = f"""WITH a AS ({q['classification_metrics']}), b AS ({q['auc_rank']}), c AS ({q['log_loss']})
SELECT a.run_id, a.accuracy, a."precision", a.recall, a.f1 AS f1_score, b.auc AS roc_auc, c.log_loss
FROM a LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id)"""
    q["first_metric"] = f"""WITH {SCORED}
SELECT run_id, CASE WHEN version_num % 5 = 0 THEN 'f1_score' ELSE 'accuracy' END AS metric_name,
       round(CASE WHEN version_num % 5 = 0 THEN f1 WHEN version_num % 7 = 3 THEN NULL ELSE accuracy END, 6) AS metric_value
FROM mt"""
    q["version_max"] = f"""WITH {SCORED}
SELECT 'doc-quality' AS model_name, max(version_num) AS max_version, arg_max(run_id, version_num) AS run_id FROM mt"""
    q["latest_run"] = f"""WITH {SCORED}
SELECT run_id, start_time FROM mt ORDER BY start_time DESC, run_id DESC LIMIT 1"""
    q["gate_decision"] = f"WITH {SCORED}, {GATE}\nSELECT * FROM gate"
    q["gate_improved"] = f"""WITH {SCORED}
SELECT m.run_id AS candidate_run_id, 'doc-quality' AS model_name, '10' AS deployed_version,
       round(m.f1, 6) AS new_metric, round(dep.df1, 6) AS old_metric, m.f1 >= dep.df1 AS improved
FROM mt m CROSS JOIN dep WHERE m.version_num <> 10"""
    q["register_versions"] = f"""WITH {SCORED},
base AS (SELECT max(version_num) AS b FROM mt WHERE version_num <= 10),
nv AS (SELECT run_id, CAST((SELECT b FROM base) + row_number() OVER (ORDER BY start_time, run_id) AS INTEGER) AS version
       FROM mt WHERE version_num > 10)
SELECT 'doc-quality' AS model_name, run_id, version, version = (SELECT max(version) FROM nv) AS is_latest FROM nv"""

    # ---- B5 approvals
    q["approval_resolve"] = f"WITH {SCORED}, {LEDGER}\nSELECT * FROM appr"
    q["approval_map"] = f"""WITH {SCORED}, {LEDGER}
SELECT seq AS event_id, run_id, action,
       CASE action WHEN 'APPROVE' THEN 'TRUE' WHEN 'REJECT' THEN 'FALSE' END AS approved_flag,
       CASE WHEN action NOT IN ('APPROVE', 'REJECT') THEN 'Invalid action' END AS error FROM led"""
    q["approval_upsert"] = f"""WITH {SCORED}, {LEDGER},
base AS (SELECT run_id, 'doc-quality' AS model_name, CAST(version_num AS VARCHAR) AS model_version,
                'PENDING' AS approved_flag FROM mt WHERE version_num <> 10),
acts AS (SELECT run_id, model_name, model_version,
                CASE action WHEN 'APPROVE' THEN 'TRUE' WHEN 'REJECT' THEN 'FALSE' END AS approved_flag, updated_on, seq
         FROM led WHERE action IN ('APPROVE', 'REJECT')),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, model_name, model_version
                                                    ORDER BY updated_on DESC, seq DESC) AS rn FROM acts) WHERE rn = 1)
SELECT coalesce(b.run_id, l.run_id) AS run_id, coalesce(b.model_name, l.model_name) AS model_name,
       coalesce(b.model_version, l.model_version) AS model_version,
       CASE WHEN l.run_id IS NOT NULL THEN l.approved_flag ELSE b.approved_flag END AS approved_flag
FROM base b FULL OUTER JOIN lst l
  ON b.run_id = l.run_id AND b.model_name = l.model_name AND b.model_version = l.model_version"""
    q["deployable"] = f"""WITH {SCORED}, {LEDGER}, {GATE}
SELECT g.candidate_run_id, g.deployed_version, g.metric_name, g.candidate_metric, g.deployed_metric, a.decision
FROM gate g JOIN appr a ON a.run_id = g.candidate_run_id
WHERE NOT g.skip_deploy AND a.decision = 'APPROVED'"""
    base = "'https://approvals.example.com/approve'"
    params = ("'?run_id=' || url_encode(run_id) || '&model_name=' || url_encode('doc-quality')"
              " || '&model_version=' || url_encode(CAST(version_num AS VARCHAR))")
    q["link_build"] = f"""WITH {SCORED}
SELECT run_id, {base} || {params} || '&action=' || url_encode('APPROVE') AS approve_url,
       {base} || {params} || '&action=' || url_encode('REJECT') AS reject_url
FROM mt WHERE version_num <> 10"""

    # ---- B6 tenants
    q["new_entities"] = f"""WITH {FEED}
SELECT customer_id, customer_name, schema_name, cloud_provider, data_path, coalesce(is_active, true) AS is_active,
       'ACTIVE' AS onboarding_status, CAST(NULL AS TIMESTAMP) AS last_pipeline_run, 'feed_onboarding' AS created_by
FROM feed WHERE customer_id NOT IN (SELECT customer_id FROM stored)"""
    q["unique_ids"] = f"""WITH {FEED},
f2 AS (SELECT customer_id, customer_name, 0 AS seq FROM feed
       UNION ALL SELECT CAST(c_custkey AS VARCHAR), upper(c_name), 1 FROM customer WHERE c_custkey % 7 = 0)
SELECT customer_id, customer_name, seq,
       CASE WHEN customer_id IN (SELECT customer_id FROM stored) THEN 'exists'
            WHEN seq = min(seq) OVER (PARTITION BY customer_id) THEN 'ok' ELSE 'duplicate' END AS status
FROM f2"""
    q["reject_reasons"] = f"""WITH {FEED},
mf AS (SELECT customer_id, nullif(concat_ws(',',
          CASE WHEN c_custkey % 11 = 0 THEN 'customer_name' END,
          CASE WHEN c_custkey % 13 = 0 THEN 'cloud_provider' END,
          CASE WHEN c_custkey % 17 = 0 THEN 'data_path' END), '') AS missing FROM feed)
SELECT customer_id, missing IS NULL AS valid,
       CASE WHEN missing IS NOT NULL THEN 'Missing field: ' || missing END AS reason FROM mf"""
    q["active_entities"] = f"WITH {FEED}\nSELECT customer_id, schema_name FROM feed WHERE is_active"
    dels = """dels AS (SELECT DISTINCT customer_id FROM (
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer WHERE c_custkey % 9 = 0
        UNION ALL SELECT 'x' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 7))"""
    q["soft_delete"] = f"""WITH {FEED}, {dels}
SELECT customer_id, CASE WHEN customer_id IN (SELECT customer_id FROM dels) THEN false ELSE is_active END AS is_active
FROM feed"""
    q["soft_delete_rejects"] = f"""WITH {FEED}, {dels}
SELECT customer_id, 'unknown id' AS reason FROM dels WHERE customer_id NOT IN (SELECT customer_id FROM feed)"""
    q["registry_upsert"] = f"""WITH {FEED},
base AS (SELECT customer_id, customer_name, is_active, TIMESTAMP '1990-01-01 00:00:00' AS updated_on
         FROM feed WHERE c_custkey % 2 = 1),
upd AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus <> 'F' AS is_active,
               o_orderdate AS updated_on, o_orderkey AS seq FROM orders),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_on DESC, seq DESC) AS rn
                       FROM upd) WHERE rn = 1)
SELECT coalesce(b.customer_id, l.customer_id) AS customer_id, b.customer_name,
       CASE WHEN l.customer_id IS NOT NULL THEN l.is_active ELSE b.is_active END AS is_active,
       CASE WHEN l.customer_id IS NOT NULL THEN l.updated_on ELSE b.updated_on END AS updated_on
FROM base b FULL OUTER JOIN lst l ON b.customer_id = l.customer_id"""
    cols = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
    ocols = "o.c_custkey, o.c_name, o.c_nationkey, o.c_acctbal, o.c_mktsegment"
    ncols = "n.c_custkey, n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment"
    diff = ("(o.c_name, o.c_nationkey, o.c_acctbal, o.c_mktsegment) IS DISTINCT FROM "
            "(n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment)")
    q["change_feed"] = f"""WITH {SNAP}
SELECT {cols}, 'insert' AS change_type FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)
UNION ALL SELECT {cols}, 'delete' FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)
UNION ALL SELECT {ocols}, 'update_preimage' FROM old o JOIN new n ON o.c_custkey = n.c_custkey WHERE {diff}
UNION ALL SELECT {ncols}, 'update_postimage' FROM old o JOIN new n ON o.c_custkey = n.c_custkey WHERE {diff}"""
    q["change_feed_digests"] = q["change_feed"]

    # ---- B7 split
    q["split_assign"] = f"""WITH {SPLIT}
SELECT c_custkey, bucket, CASE WHEN bucket < 2000 THEN 'test' ELSE 'train' END AS split FROM s"""
    q["split_exact"] = """SELECT c_custkey,
       CASE WHEN row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '#42'), c_custkey)
                 <= ceil(0.2::DOUBLE * (SELECT count(*) FROM customer)) THEN 'test' ELSE 'train' END AS split
FROM customer"""
    q["split_counts"] = f"""WITH {SPLIT}
SELECT CASE WHEN bucket < 2000 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY 1"""

    # ---- B8 medallion
    q["bronze_raw"] = f"WITH {LANDING}\nSELECT source_file, raw_payload FROM bronze"
    q["silver_clean"] = f"WITH {LANDING}\nSELECT record_id, clean_payload FROM silver"
    q["gold_features"] = f"""WITH {LANDING},
g AS (SELECT record_id, CAST(json_extract_string(clean_payload, '$.value_cents') AS BIGINT) AS vc,
             CAST(json_extract_string(clean_payload, '$.k') AS INTEGER) AS k FROM silver)
SELECT record_id, CAST(vc AS DOUBLE) / CAST(100 AS DOUBLE) AS feature_1, CAST(k AS DOUBLE) AS feature_2,
       CAST(CAST(vc AS DOUBLE) / CAST(100 AS DOUBLE) >= 50 AS INTEGER) AS label FROM g"""

    # ---- tables / profiles / encodings
    q["table_scan"] = "SELECT * FROM orders"
    q["head_row"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1"
    q["table_version"] = """WITH v AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS version, count(*) AS n,
                  max(o_orderdate) AS ts FROM orders GROUP BY 1)
SELECT 'orders' AS table_name, max(version) AS version, arg_max(n, version) AS n_rows,
       arg_max(ts, version) AS committed_at, count(*) AS n_versions FROM v"""
    q["numeric_profile"] = """SELECT o_orderstatus, count(*) AS n_rows, round(avg(o_totalprice), 6) AS mean_o_totalprice,
       round(stddev_samp(o_totalprice), 6) AS std_o_totalprice, min(o_orderdate) AS min_o_orderdate,
       max(o_orderdate) AS max_o_orderdate FROM orders GROUP BY o_orderstatus"""
    q["value_counts"] = "SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type"
    q["distinct_values"] = """SELECT count(DISTINCT p_type) AS n_distinct_p_type, count(DISTINCT p_brand) AS n_distinct_p_brand,
       count(DISTINCT p_name) AS n_distinct_p_name FROM part"""
    q["value_freqs"] = """SELECT role, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM conversations WHERE role IS NOT NULL), 6) AS freq
FROM conversations WHERE role IS NOT NULL GROUP BY role"""
    q["cat_codes"] = CAT_MAP.format(key="p_partkey", col="p_type", table="part", fit_filter="")
    q["cat_codes_unseen"] = CAT_MAP.format(key="doc_id", col="lang", table="documents",
                                           fit_filter="AND lang <> 'en'")
    q["latest_state"] = """SELECT user_id, event_type = 'click' AS allow_training, ts AS updated_on
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1"""
    q["safe_casts"] = """SELECT page_id, CAST(page_id AS VARCHAR) AS page_id_text,
       TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS url_number,
       TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS DOUBLE) AS url_number_d,
       CAST(starts_with(url, 'https') AS INTEGER) AS is_secure FROM pages"""
    q["name_slug"] = """SELECT s_suppkey,
       left(translate(lower(s_name || '.models_' || s_name || '.quality_classifier'), '._', '--') || '-serving-dev', 63)
         AS endpoint_name FROM supplier"""

    # ---- synthetic data
    q["synth_rows"] = f"WITH {SYNTH_NUM}\nSELECT Id, round(x, 6) AS c_acctbal FROM syn"
    q["synth_category"] = f"""WITH c AS (SELECT c_mktsegment AS cat, count(*) AS n FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS tot FROM c),
iv AS (SELECT cat, (sum(n) OVER (ORDER BY cat) - n) / tot AS lo, sum(n) OVER (ORDER BY cat) / tot AS hi
       FROM c CROSS JOIN t),
u AS (SELECT c_custkey, {_u('c_custkey', '#cat')} AS u FROM customer)
SELECT CAST(1700000000000 + c_custkey AS VARCHAR) AS Id, iv.cat AS c_mktsegment
FROM u JOIN iv ON u.u >= iv.lo AND u.u < iv.hi"""
    q["drift_inject"] = f"""WITH {SYNTH_NUM}
SELECT Id, round(x * 1.5::DOUBLE, 6) AS c_acctbal,
       CASE WHEN {_u('c_custkey', '#drift')} < 0.7::DOUBLE THEN 'BUILDING' ELSE 'AUTOMOBILE' END AS c_mktsegment
FROM syn"""
    q["tenant_layers"] = f"""WITH {LANDING},
tb AS (SELECT 'c' || CAST(e.user_id AS VARCHAR) AS customer_id, l.raw_payload
       FROM (SELECT event_id, raw_payload FROM ln UNION ALL SELECT event_id, raw_payload FROM ln WHERE event_id % 40 = 0) l
       JOIN events e USING (event_id)),
ts AS (SELECT DISTINCT customer_id, trim(raw_payload) AS cp FROM tb),
sv AS (SELECT customer_id, sha256(cp) AS record_id, cp FROM ts
       WHERE cp <> '' AND json_valid(cp) AND json_extract(cp, '$.event_id') IS NOT NULL
         AND json_extract(cp, '$.value_cents') IS NOT NULL AND json_extract(cp, '$.k') IS NOT NULL)
SELECT customer_id, record_id,
       CAST(CAST(json_extract_string(cp, '$.value_cents') AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) AS feature_1,
       CAST(CAST(json_extract_string(cp, '$.k') AS INTEGER) AS DOUBLE) AS feature_2,
       CAST(CAST(CAST(json_extract_string(cp, '$.value_cents') AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) >= 50 AS INTEGER) AS label,
       TIMESTAMP '2024-03-01 00:00:00' AS train_ts
FROM sv"""
    # ---- end-to-end jobs
    q["prepare_dataset"] = f"""WITH fp AS ({q['feature_prep']})
SELECT *, TIMESTAMP '2024-03-01 00:00:00' AS update_timestamp_utc,
       CASE WHEN (('0x' || substr(md5(Id || '#42'), 1, 8))::BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS split
FROM fp"""
    q["monitoring_refresh"] = f"""WITH {PAYLOAD}
SELECT pos, {FLAT_POS_COLS} FROM recs WHERE NOT no_pred"""
    q["onboard_run"] = f"""WITH {FEED},
g AS (SELECT customer_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE customer_name END AS customer_name, schema_name,
             CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cloud_provider END AS cloud_provider,
             CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE data_path END AS data_path, is_active, c_custkey FROM feed),
rows_ AS (SELECT customer_id, customer_name, schema_name, cloud_provider, data_path, is_active FROM feed
          WHERE c_custkey % 2 = 1
          UNION ALL
          SELECT customer_id, customer_name, schema_name, cloud_provider, data_path, is_active FROM g
          WHERE c_custkey % 2 = 0 AND customer_name IS NOT NULL AND cloud_provider IS NOT NULL AND data_path IS NOT NULL)
SELECT customer_id, customer_name, schema_name, cloud_provider, data_path, coalesce(is_active, true) AS is_active,
       'ACTIVE' AS onboarding_status, CAST(NULL AS TIMESTAMP) AS last_pipeline_run, 'feed_onboarding' AS created_by,
       TIMESTAMP '2024-03-01 00:00:00' AS created_at, TIMESTAMP '2024-03-01 00:00:00' AS updated_at FROM rows_"""
    q["monitoring_refresh_twice"] = q["monitoring_refresh"]
    q["tenant_layers_two_loads"] = q["tenant_layers"]
    q["onboard_rejects"] = f"""WITH {FEED},
g AS (SELECT customer_id, c_custkey,
             CASE WHEN c_custkey % 11 = 0 THEN 'customer_name' WHEN c_custkey % 13 = 0 THEN 'cloud_provider'
                  WHEN c_custkey % 17 = 0 THEN 'data_path' END AS first_gap,
             concat_ws(',', CASE WHEN c_custkey % 11 = 0 THEN 'customer_name' END,
                       CASE WHEN c_custkey % 13 = 0 THEN 'cloud_provider' END,
                       CASE WHEN c_custkey % 17 = 0 THEN 'data_path' END) AS gaps FROM feed),
twice AS (SELECT *, 0 AS seq FROM g UNION ALL SELECT *, 1 FROM g WHERE c_custkey % 7 = 0)
SELECT customer_id, CASE WHEN first_gap IS NOT NULL THEN 'Missing field: ' || gaps
                         WHEN c_custkey % 2 = 1 THEN 'Existing id' ELSE 'Duplicate id' END AS reason
FROM twice WHERE first_gap IS NOT NULL OR c_custkey % 2 = 1 OR seq = 1"""
    for key, keys, price, status in (
            ("synth_table", "SELECT o_orderkey AS k FROM orders", "round(x, 3)", "st.cat"),
            ("synth_test_rows", "SELECT range AS k FROM range(100)", "round(round(x, 3) * 1.5::DOUBLE, 4)",
             f"CASE WHEN {_u('k', '#drift')} < 0.7::DOUBLE THEN 'P' ELSE 'F' END")):
        q[key] = f"""WITH keys AS ({keys}),
prof AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd, epoch_us(min(o_orderdate)) AS lo,
                epoch_us(max(o_orderdate)) AS hi FROM orders),
iv AS (SELECT col, cat, (sum(n) OVER (PARTITION BY col ORDER BY cat) - n) / sum(n) OVER (PARTITION BY col) AS lo,
              sum(n) OVER (PARTITION BY col ORDER BY cat) / sum(n) OVER (PARTITION BY col) AS hi
       FROM (SELECT 'p' AS col, o_orderpriority AS cat, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
             UNION ALL SELECT 's', o_orderstatus, count(*) FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2)),
u AS (SELECT k, greatest(0.1::DOUBLE, mu + sd * (sqrt(-2.0::DOUBLE * ln({_u_open('k', '#42a')}))
                                      * cos(2 * pi() * {_u('k', '#42b')}))) AS x,
             make_timestamp(lo + floor({_u('k', '#o_orderdate')} * (hi - lo))::BIGINT) AS ts,
             {_u('k', '#o_orderpriority')} AS up, {_u('k', '#o_orderstatus')} AS us FROM keys CROSS JOIN prof)
SELECT CAST(1700000000000 + k AS VARCHAR) AS Id, {price} AS o_totalprice, u.ts AS o_orderdate,
       pr.cat AS o_orderpriority, {status} AS o_orderstatus
FROM u JOIN iv pr ON pr.col = 'p' AND up >= pr.lo AND up < pr.hi JOIN iv st ON st.col = 's' AND us >= st.lo AND us < st.hi"""
    # ---- streaming (results equal the batch operators)
    q["stream_flatten"] = f"WITH {PAYLOAD}\nSELECT {FLAT_POS_COLS} FROM recs"
    q["stream_dedup"] = q["stream_flatten"]
    q["monitoring_refresh_all_null"] = f"WITH {PAYLOAD}\nSELECT {FLAT_POS_COLS}, pos FROM recs WHERE user_id % 10 < 2"
    q["stream_dedup_exact"] = q["stream_flatten"]
    q["stream_window"] = q["window_profile"]
    q["stream_late_rows"] = f"WITH {PAYLOAD},\npay AS (SELECT DISTINCT request_id, request_time FROM recs),{LATE_ROWS}"
    q["stream_onboard"] = f"""WITH {FEED}
SELECT customer_id, customer_name, schema_name, cloud_provider, data_path, coalesce(is_active, true) AS is_active,
       'ACTIVE' AS onboarding_status, CAST(NULL AS TIMESTAMP) AS last_pipeline_run, 'feed_onboarding' AS created_by
FROM feed"""
    q["stream_approvals"] = f"""WITH {SCORED}, {LEDGER}
SELECT run_id, approved_flag, updated_on, seq FROM lastled"""
    q["stream_approvals_csv"] = q["stream_approvals"]
    return q
