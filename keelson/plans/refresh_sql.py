"""DuckDB SQL of the refreshed-state queries: the same results in one pass over
raw rows (sketches of this size are exact)."""

from __future__ import annotations

import math
from itertools import accumulate

# windows w, reference r (by model, or by model and window); per value of a
# window its cumulative share there and in the reference, at and just below it
DISTANCES = """
wv AS (SELECT {key}, v, count(*) AS c FROM w GROUP BY ALL),
wc AS (SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY v) AS cum, sum(c) OVER (PARTITION BY {key}) AS n FROM wv),
rv AS (SELECT {ref}, v, count(*) AS c FROM r GROUP BY ALL),
rc AS (SELECT *, sum(c) OVER (PARTITION BY {ref} ORDER BY v) AS cum, sum(c) OVER (PARTITION BY {ref}) AS n FROM rv),
steps AS (SELECT wc.*, a.cum AS at_r, a.n AS n_r FROM wc ASOF LEFT JOIN rc a ON {on_a} AND wc.v >= a.v),
both_limits AS (SELECT steps.*, b.cum AS below_r FROM steps ASOF LEFT JOIN rc b ON {on_b} AND steps.v > b.v),
rn AS (SELECT {ref}, max(n) AS n_r FROM rc GROUP BY ALL),
ks AS (SELECT {key_b}, max(greatest(abs(x.cum / x.n - coalesce(at_r, 0) / rn.n_r), abs((x.cum - x.c) / x.n - coalesce(below_r, 0) / rn.n_r))) AS ks
       FROM both_limits x JOIN rn ON {on_n} GROUP BY ALL),
edges AS (SELECT {ref}, i, min(v) AS e FROM rc, range(1, 10) g(i) WHERE cum >= ceil(i / 10.0::DOUBLE * n) GROUP BY ALL),
rank_r AS (SELECT {ref_e}, i, e, max(rc.cum) / any_value(rc.n) AS fr FROM edges JOIN rc ON {on_e} AND rc.v <= e GROUP BY ALL),
wk AS (SELECT {key}, any_value(n) AS n FROM wc GROUP BY ALL),
rank_w AS (SELECT {key_k}, i, e, fr, coalesce(max(wc.cum) FILTER (wc.v <= e), 0) / any_value(wk.n) AS fw
           FROM wk JOIN rank_r ON {on_k} JOIN wc ON {on_w} GROUP BY ALL),
full_ranks AS (SELECT {key}, i, fr, fw FROM rank_w UNION ALL SELECT DISTINCT {key}, 0, 0.0, 0.0 FROM rank_w
               UNION ALL SELECT DISTINCT {key}, 10, 1.0, 1.0 FROM rank_w),
shares AS (SELECT {key}, i, fr - lag(fr) OVER k AS p, fw - lag(fw) OVER k AS q FROM full_ranks WINDOW k AS (PARTITION BY {key} ORDER BY i)),
psi AS (SELECT {key}, sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))) AS psi
        FROM shares WHERE i > 0 GROUP BY ALL),
sizes AS (SELECT {key}, count(v) AS n_values FROM w_all GROUP BY ALL)
"""

VALUES = """m AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type AS model_name, value AS v FROM events)"""

BASELINE = "WITH " + VALUES + """,
w_all AS (SELECT * FROM m WHERE window_start >= TIMESTAMP '2024-01-16 00:00:00'),
w AS (SELECT * FROM w_all WHERE v IS NOT NULL),
r AS (SELECT model_name, v FROM m WHERE window_start < TIMESTAMP '2024-01-16 00:00:00' AND v IS NOT NULL),""" + DISTANCES.format(
    key="model_name, window_start", ref="model_name", on_a="wc.model_name = a.model_name", on_b="steps.model_name = b.model_name",
    key_b="x.model_name, x.window_start", on_n="x.model_name = rn.model_name", on_e="edges.model_name = rc.model_name",
    ref_e="edges.model_name", key_k="wk.model_name, wk.window_start", on_k="wk.model_name = rank_r.model_name",
    on_w="wc.model_name = wk.model_name AND wc.window_start = wk.window_start")

PREVIOUS = "WITH " + VALUES + """,
w_all AS (SELECT * FROM m),
w AS (SELECT * FROM w_all WHERE v IS NOT NULL),
r AS (SELECT model_name, window_start + INTERVAL 30 MINUTE AS rs, v FROM w),""" + DISTANCES.format(
    key="model_name, window_start", ref="model_name, rs",
    on_a="wc.model_name = a.model_name AND wc.window_start = a.rs", on_b="steps.model_name = b.model_name AND steps.window_start = b.rs",
    key_b="x.model_name, x.window_start", on_n="x.model_name = rn.model_name AND x.window_start = rn.rs",
    on_e="edges.model_name = rc.model_name AND edges.rs = rc.rs", ref_e="edges.model_name, edges.rs",
    key_k="wk.model_name, wk.window_start", on_k="wk.model_name = rank_r.model_name AND wk.window_start = rank_r.rs",
    on_w="wc.model_name = wk.model_name AND wc.window_start = wk.window_start")


LATE_ROWS = """
slices(batch, first, past) AS (VALUES (0, TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15'), (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08'),
    (2, TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22'), (3, TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-22'),
    (4, TIMESTAMP '2024-01-22', TIMESTAMP '2099-01-01')),
arrived AS (SELECT batch, request_id, request_time FROM slices JOIN pay ON request_time >= first AND request_time < past),
lasts AS (SELECT batch, max(request_time) AS last FROM arrived GROUP BY batch),
marks AS (SELECT s.batch, max(l.last) - INTERVAL 2 DAY AS mark FROM slices s LEFT JOIN lasts l ON l.batch < s.batch GROUP BY s.batch),
ready AS (SELECT a.*, coalesce(a.request_time < m.mark, false) AS late FROM arrived a JOIN marks m USING (batch)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id, late ORDER BY batch) AS nth FROM ready)
SELECT s.batch::BIGINT AS batch, count(n.batch) AS n_input, count(*) FILTER (NOT late AND nth = 1) AS n_on_time,
       count(*) FILTER (NOT late AND nth > 1) AS n_repeated, count(*) FILTER (late) AS n_late
FROM slices s LEFT JOIN numbered n USING (batch) GROUP BY s.batch"""


SNAPSHOT_DIGESTS = """SELECT c_custkey // 100 AS bucket, count(*) AS n_rows FROM customer
WHERE c_custkey // 100 IN (SELECT c_custkey // 100 FROM customer WHERE c_custkey BETWEEN 10 AND 120) GROUP BY 1"""

POISSON_STEPS = "[" + ", ".join(
    repr(s) + "::DOUBLE" for s in accumulate(math.exp(-1.0) / math.factorial(k) for k in range(12))) + "]"

GATE_RESCORED = f"""WITH e AS (SELECT doc_id, quality = 1 AS y, n_chars >= 1500 AS said_new, n_chars >= 2000 AS said_old
                               FROM documents JOIN labels USING (doc_id)),
w AS (SELECT e.*, r, CASE WHEN r = 0 THEN 1 ELSE len(list_filter({POISSON_STEPS}, lambda s: s <=
        ('0x' || substr(md5(doc_id::VARCHAR || '|' || r::VARCHAR || '#42w'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) END AS n
      FROM e, range(51) t(r)),
s AS (SELECT r, sum(n) FILTER (y AND said_new) AS tn, sum(n) FILTER (y <> said_new) AS fn,
             sum(n) FILTER (y AND said_old) AS t_o, sum(n) FILTER (y <> said_old) AS fo FROM w GROUP BY r),
f AS (SELECT r, coalesce(2.0::DOUBLE * tn / nullif(2 * tn + coalesce(fn, 0), 0), 0) AS new,
             coalesce(2.0::DOUBLE * t_o / nullif(2 * t_o + coalesce(fo, 0), 0), 0) AS old FROM s),
g AS (SELECT round(max(new) FILTER (r = 0), 6) AS new_f1, round(max(old) FILTER (r = 0), 6) AS old_f1,
             round(quantile_cont(new - old, 0.05) FILTER (r > 0), 6) AS diff_low,
             round(quantile_cont(new - old, 0.95) FILTER (r > 0), 6) AS diff_high FROM f)
SELECT 'doc-quality' AS model_name, '3' AS champion_version, new_f1, old_f1, diff_low, diff_high, new_f1 >= old_f1 AS improved,
       NULL::VARCHAR AS reason FROM g"""

TRAIN_REGISTER = """WITH RECURSIVE rules(k, least) AS (VALUES (0, 4000), (1, 1500), (2, 20000), (3, 1000)),
c AS (SELECT k, count(*) FILTER (quality = 1 AND n_chars >= least) AS tp, count(*) FILTER ((quality = 1) <> (n_chars >= least)) AS wrong
      FROM documents JOIN labels USING (doc_id), rules GROUP BY k),
f AS (SELECT k, round(CASE WHEN 2 * tp + wrong > 0 THEN 2.0::DOUBLE * tp / (2 * tp + wrong) ELSE 0 END, 6) AS f1 FROM c),
walk AS (SELECT k, f1 AS best, 1 AS version, true AS registered FROM f WHERE k = 0
         UNION ALL SELECT f.k, greatest(f.f1, best), version + CAST(f.f1 >= best AS INTEGER), f.f1 >= best
         FROM walk JOIN f ON f.k = walk.k + 1)
SELECT 'run-' || k AS run_id, f1, CASE WHEN registered THEN version END AS version FROM walk JOIN f USING (k)"""

RUN_LINEAGE = """SELECT 'run-' || k AS run_id, t AS table_name, k::VARCHAR AS version, c AS context, false AS training_allowed
FROM range(4) r(k), (VALUES ('documents', 'training'), ('labels', 'evaluation')) v(t, c)"""

PIPELINE_CODES = """WITH m AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code
                               FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'en'))
SELECT doc_id, coalesce(code, -1)::INTEGER AS lang_code, coalesce(code, -1)::DOUBLE AS first, n_chars::DOUBLE AS second
FROM documents LEFT JOIN m USING (lang)"""

LINEAGE_CLOSURE = """WITH RECURSIVE i AS (SELECT DISTINCT o_orderpriority AS run_id, o_custkey AS node FROM orders WHERE o_orderkey % 200 = 0),
d AS (SELECT c_custkey AS node, c_custkey // 2 AS source FROM customer WHERE c_custkey > 1
      UNION SELECT c_custkey, c_custkey // 3 FROM customer WHERE c_custkey % 3 = 0
      UNION SELECT c_custkey // 8, c_custkey FROM customer WHERE c_custkey % 8 = 0),
reach AS (SELECT run_id, node, 0 AS distance FROM i
          UNION SELECT run_id, source, distance + 1 FROM reach JOIN d USING (node) WHERE distance < 40)
SELECT run_id, node, min(distance) AS distance FROM reach GROUP BY run_id, node"""

TYPED = """rec AS (SELECT *, PageID AS id, PageID // 50 AS g, CAST(row_number() OVER (PARTITION BY PageID // 50 ORDER BY PageID) - 1 AS INTEGER) AS pos
               FROM entity JOIN (SELECT p_partkey AS PageID, p_name FROM part) USING (PageID)),
judged AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'record is not an object' WHEN id % 13 = 0 THEN 'Height is not double'
                          WHEN id % 29 = 0 THEN 'Weight is not double'
                          WHEN g % 5 <> 4 AND id % 19 = 0 THEN 'prediction is not a whole number' END AS reason
           FROM rec WHERE g % 7 <> 6)"""

PAYLOAD_TYPED = """SELECT 'req-' || g AS request_id, pos, "Height (m)" AS Height, "Weight (kg)" AS Weight, Universe, Identity, Gender,
       "Marital Status" AS Marital_Status, Teams, Origin, CASE WHEN contains(p_name, 'ring') THEN 'True' ELSE 'False' END AS Magic,
       CASE WHEN contains(p_name, 'anvil') THEN 'True' ELSE 'False' END AS Mutant,
       CASE WHEN g % 5 <> 4 THEN CASE WHEN id % 23 = 0 THEN 1 ELSE CAST(id % 2 AS INTEGER) END END AS prediction
FROM judged WHERE reason IS NULL"""

PAYLOAD_REJECTS = """SELECT 'req-' || g AS request_id, pos, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT 'req-' || g, NULL::INTEGER, 'request is not JSON' FROM rec WHERE g % 7 = 6"""


CONTROL_FLAG = """SELECT arg_max(event_type = 'click', ts + to_microseconds(event_id)) AS allow_training
FROM events WHERE event_type IN ('click', 'error')"""

APPROVAL_REQUESTS = """SELECT run_id, 'doc-quality' AS model_name, CAST(version_num AS VARCHAR) AS model_version, 'PENDING' AS status,
       TIMESTAMP '2024-03-01 00:00:00' AS requested_on FROM mt WHERE version_num <> 10"""

RUN_LOG = """SELECT run_id, TIMESTAMP '2024-03-01 00:00:00' AS start_time, '6' AS max_depth, round(accuracy, 6) AS accuracy,
       round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mt"""

PROVISIONING = """SELECT customer_id, schema_name, layer FROM feed, (VALUES ('bronze_raw'), ('silver_clean'), ('gold_features')) v(layer)
WHERE is_active"""


def refresh_sql(profile: str, entity: str, scored: str, feed: str) -> dict[str, str]:
    """``profile`` is the one-pass window profile; the others are the fixtures of
    raw entities, scored runs and the tenant feed."""
    q = {"window_profile_refreshes": profile, "snapshot_digests": SNAPSHOT_DIGESTS, "gate_rescored": GATE_RESCORED,
         "train_register_runs": TRAIN_REGISTER, "run_lineage": RUN_LINEAGE, "pipeline_codes": PIPELINE_CODES,
         "lineage_closure": LINEAGE_CLOSURE, "payload_typed": f"WITH {entity}, {TYPED}\n{PAYLOAD_TYPED}",
         "payload_rejects": f"WITH {entity}, {TYPED}\n{PAYLOAD_REJECTS}", "control_flag": CONTROL_FLAG,
         "approval_requests": f"WITH {scored}\n{APPROVAL_REQUESTS}", "run_log": f"WITH {scored}\n{RUN_LOG}",
         "tenant_provisioning": f"WITH {feed}\n{PROVISIONING}"}
    base = BASELINE + """SELECT s.model_name, s.window_start, s.n_values, coalesce(rn.n_r, 0)::BIGINT AS n_reference, {cols}
FROM sizes s LEFT JOIN rn USING (model_name) LEFT JOIN psi USING (model_name, window_start) LEFT JOIN ks USING (model_name, window_start)"""
    q["window_psi"] = base.format(cols="round(psi, 6) AS psi, round(psi, 6) AS psi_low, round(psi, 6) AS psi_high")
    q["window_ks"] = base.format(cols="round(ks, 6) AS ks, CASE WHEN ks IS NOT NULL THEN 0.0::DOUBLE END AS ks_error")
    q["window_drift_sketched"] = PREVIOUS + """SELECT s.model_name, s.window_start, s.n_values, coalesce(rn.n_r, 0)::BIGINT AS n_reference,
       round(psi, 6) AS psi, round(ks, 6) AS ks
FROM sizes s LEFT JOIN rn ON rn.model_name = s.model_name AND rn.rs = s.window_start
LEFT JOIN psi ON psi.model_name = s.model_name AND psi.window_start = s.window_start
LEFT JOIN ks ON ks.model_name = s.model_name AND ks.window_start = s.window_start"""
    return q
