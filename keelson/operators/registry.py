"""Model registry data flow: latest-wins reads, upsert, version numbering,
deployment gates and approval resolution.

Registry tables: ``model_runs(run_id, start_time, params, metrics, ...)``,
``model_versions(model_name, version, run_id, created_at)``,
``model_aliases(model_name, alias, version)``, an approvals ledger.

"Latest per key" is always ``max_by`` in a grouped aggregate (partial
aggregation map-side) rather than ``row_number()`` over a key partition, so
one key holding a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import (
    action_to_flag, approval_decision, approval_link, first_present_metric, flag_text,
)
from keelson.operators.ordered import running_totals

__all__ = [
    "latest_by_key", "latest_row", "max_version", "upsert", "resolve_deployed",
    "metric_value", "gate_decision", "gate_improved", "register_versions",
    "resolve_approvals", "map_actions", "deployable", "approval_links", "latest_state",
]

# --- fixed values of the original deployment flow ---
DEFAULT_ALIAS = "latest-model"
DEFAULT_GATE_METRICS = ("accuracy", "f1_score")
NO_VERSION = "0"
NO_RUN = "UNKNOWN"
# --- end of fixed values ---


def latest_by_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str]) -> DataFrame:
    """For each key, the value columns of the row with the greatest order tuple."""
    order = F.struct(*[F.col(c) for c in order_cols])
    vals = F.struct(*[F.col(c) for c in value_cols])
    agg = df.groupBy(*key_cols).agg(F.max_by(vals, order).alias("__v"))
    return agg.select(*key_cols, *[F.col(f"__v.{c}").alias(c) for c in value_cols])


def latest_row(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """The single newest row (TakeOrderedAndProject: a top-1 per task, then one merge)."""
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(1)


def latest_state(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                 value_cols: Sequence[str]) -> DataFrame:
    """Latest-wins read of an append-only state table (one row per key)."""
    return latest_by_key(df, key_cols, order_cols, list(value_cols) + list(order_cols[:1]))


def max_version(versions: DataFrame, model_col: str = "model_name", version_col: str = "version",
                run_col: str = "run_id") -> DataFrame:
    """Highest version per model, compared as a number ("10" > "9")."""
    v = F.col(version_col).cast("int")
    return versions.groupBy(model_col).agg(
        F.max(v).alias("max_version"), F.max_by(F.col(run_col), v).alias(run_col))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           order_cols: Sequence[str]) -> DataFrame:
    """Update ``update_cols`` of matching rows, append the others.

    Several updates of one key in a batch: the greatest ``order_cols`` wins.
    Columns of ``base`` missing from ``updates`` are null on appended rows."""
    keys, update_cols = list(keys), list(update_cols)
    latest = latest_by_key(updates, keys, order_cols, update_cols)
    u = latest.select(*keys, F.lit(True).alias("__has_update"),
                      *[F.col(c).alias(f"__u_{c}") for c in update_cols])
    j = base.join(u, keys, "full_outer")
    out = []
    for c in base.columns:
        if c in update_cols:
            out.append(F.when(F.col("__has_update"), F.col(f"__u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def current_aliases(aliases: DataFrame, model_col: str = "model_name") -> DataFrame:
    """Newest row per (model, alias) of the alias log (greatest ``updated_at``
    where the table has it, then the greatest version number)."""
    order = [c for c in ("updated_at",) if c in aliases.columns] + ["__number"]
    return latest_by_key(aliases.withColumn("__number", F.col("version").cast("int")), [model_col, "alias"],
                         order, ["version"])


def current_runs(runs: DataFrame) -> DataFrame:
    """Newest log row of every run (a run that was logged again counts once)."""
    if "start_time" not in runs.columns:
        return runs.select("run_id", "metrics")
    return latest_by_key(runs, ["run_id"], ["start_time"], ["metrics"])


def resolve_deployed(models: DataFrame, versions: DataFrame, aliases: DataFrame,
                     alias: str = DEFAULT_ALIAS, model_col: str = "model_name") -> DataFrame:
    """Deployed (version, run) per model: alias -> highest version -> ("0", UNKNOWN).

    ``aliases`` is a log: the newest row of a model's alias counts."""
    a = (current_aliases(aliases, model_col).where(F.col("alias") == alias)
         .select(model_col, F.col("version").alias("__alias_version")))
    a_run = a.join(versions.select(model_col, F.col("version").alias("__alias_version"),
                                   F.col("run_id").alias("__alias_run")),
                   [model_col, "__alias_version"], "left")
    mx = max_version(versions, model_col).select(
        model_col, F.col("max_version").cast("string").alias("__max_version"),
        F.col("run_id").alias("__max_run"))
    j = models.join(a_run, model_col, "left").join(mx, model_col, "left")
    return j.select(
        "*",
        F.coalesce("__alias_version", "__max_version", F.lit(NO_VERSION)).alias("deployed_version"),
        F.when(F.col("__alias_version").isNotNull(), F.coalesce("__alias_run", F.lit(NO_RUN)))
         .otherwise(F.coalesce("__max_run", F.lit(NO_RUN))).alias("deployed_run_id"),
    ).drop("__alias_version", "__alias_run", "__max_version", "__max_run")


def metric_value(metrics_col: str, name: str):
    return (F.element_at(F.col(metrics_col), F.lit(name)).cast("string")).try_cast("double")


def gate_decision(cands: DataFrame, runs: DataFrame, versions: DataFrame, aliases: DataFrame,
                  metric_names: Sequence[str] = DEFAULT_GATE_METRICS, *, strict: bool = False,
                  tie_passes: bool = False, enforce: bool = True, alias: str = DEFAULT_ALIAS) -> DataFrame:
    """Deployment gate: candidate vs the deployed model, one row per candidate.

    Default: compare the first metric *both* runs have (castable); ties fail
    unless ``tie_passes``.  ``strict=True`` picks each run's first present
    metric independently (original behaviour).  Missing metric -> not
    skipped.  ``enforce=False`` never sets skip_deploy (original bypass)."""
    dep = resolve_deployed(cands, versions, aliases, alias)
    m = current_runs(runs)
    j = (dep.join(m.withColumnRenamed("run_id", "candidate_run_id")
                  .withColumnRenamed("metrics", "__cm"), "candidate_run_id", "left")
         .join(m.withColumnRenamed("run_id", "deployed_run_id")
               .withColumnRenamed("metrics", "__dm"), "deployed_run_id", "left"))
    if strict:
        cv, cn = first_present_metric("__cm", metric_names)
        dv, _ = first_present_metric("__dm", metric_names)
        name = F.when(cv.isNotNull() & dv.isNotNull(), cn)
        cand_v, dep_v = cv, dv
    else:
        name = cand_v = dep_v = None
        for n in metric_names:
            c, d = metric_value("__cm", n), metric_value("__dm", n)
            both = c.isNotNull() & d.isNotNull()
            name = F.when(both, F.lit(n)) if name is None else name.when(both, F.lit(n))
            cand_v = F.when(both, c) if cand_v is None else cand_v.when(both, c)
            dep_v = F.when(both, d) if dep_v is None else dep_v.when(both, d)
    j = j.withColumns({"metric_name": name, "candidate_metric": cand_v, "deployed_metric": dep_v})
    cmp = (F.col("candidate_metric") >= F.col("deployed_metric")) if tie_passes else \
        (F.col("candidate_metric") > F.col("deployed_metric"))
    better = F.when(F.col("metric_name").isNotNull(), cmp)
    skip = F.coalesce(~better, F.lit(False)) if enforce else F.lit(False)
    return j.select("candidate_run_id", "model_name", "deployed_version", "deployed_run_id",
                    "metric_name", "candidate_metric", "deployed_metric",
                    better.alias("better"), skip.alias("skip_deploy"))


def gate_improved(cands: DataFrame, runs: DataFrame, versions: DataFrame, aliases: DataFrame,
                  metric: str = "f1_score", *, tie_passes: bool = True,
                  alias: str = DEFAULT_ALIAS) -> DataFrame:
    """Champion/challenger on one metric: a first run, a model without the
    alias, and a missing metric pass; otherwise new >= old (ties pass by
    default)."""
    named = (current_aliases(aliases).where(F.col("alias") == alias)
             .select("model_name", F.lit(True).alias("__named")))
    dep = resolve_deployed(cands, versions, aliases, alias).join(named, "model_name", "left")
    m = current_runs(runs).select("run_id", metric_value("metrics", metric).alias("__v"))
    j = (dep.join(m.select(F.col("run_id").alias("candidate_run_id"), F.col("__v").alias("new_metric")),
                  "candidate_run_id", "left")
         .join(m.select(F.col("run_id").alias("deployed_run_id"), F.col("__v").alias("old_metric")),
               "deployed_run_id", "left"))
    cmp = (F.col("new_metric") >= F.col("old_metric")) if tie_passes else \
        (F.col("new_metric") > F.col("old_metric"))
    improved = F.when(F.col("__named").isNull() | (F.col("deployed_version") == NO_VERSION), F.lit(True)) \
        .when(F.col("new_metric").isNull() | F.col("old_metric").isNull(), F.lit(True)) \
        .otherwise(cmp)
    return j.select("candidate_run_id", "model_name", "deployed_version", "new_metric", "old_metric",
                    improved.alias("improved"))


def register_versions(versions: DataFrame, new_runs: DataFrame, *, model_col: str = "model_name",
                      order_cols: Sequence[str] = ("start_time", "run_id")) -> DataFrame:
    """Register runs not yet in ``versions``: version = model's max + 1, + 2 ...
    in ``order_cols`` order; ``is_latest`` marks where the alias moves.

    Numbering is a distributed running count per model (no single-task
    window), so a model with a huge backlog of runs is still spread out."""
    fresh = new_runs.join(versions.select("run_id"), "run_id", "left_anti")
    fresh = latest_by_key(fresh, [model_col, "run_id"], order_cols[:1], [c for c in order_cols if c != "run_id"])
    base = versions.groupBy(model_col).agg(F.max(F.col("version").cast("int")).alias("__base"))
    numbered = running_totals(fresh.withColumn("__one", F.lit(1)), list(order_cols), ["__one"], [model_col])
    out = numbered.join(base, model_col, "left").select(
        model_col, "run_id",
        (F.coalesce(F.col("__base"), F.lit(0)) + F.col("cum___one")).cast("int").alias("version"))
    top = out.groupBy(model_col).agg(F.max("version").alias("__top"))
    return out.join(top, model_col).select(model_col, "run_id", "version",
                                           (F.col("version") == F.col("__top")).alias("is_latest"))


def resolve_approvals(requests: DataFrame, ledger: DataFrame, *, key_cols: Sequence[str] = ("run_id",),
                      request_keys: Sequence[str] | None = None,
                      order_cols: Sequence[str] = ("updated_on", "seq"),
                      flag_col: str = "approved_flag") -> DataFrame:
    """Decision per request: the last ledger row of the key wins; its trimmed,
    upper-cased flag maps TRUE->APPROVED, FALSE->REJECTED, else PENDING; no
    row -> PENDING.  Keys are compared as strings."""
    key_cols = list(key_cols)
    request_keys = list(request_keys) if request_keys else key_cols
    led = ledger.select(*[F.col(c).cast("string").alias(f"__k{i}") for i, c in enumerate(key_cols)],
                        *order_cols, flag_col)
    last = latest_by_key(led, [f"__k{i}" for i in range(len(key_cols))], order_cols, [flag_col])
    cond = [requests[rk].cast("string") == last[f"__k{i}"] for i, rk in enumerate(request_keys)]
    j = requests.join(last, cond, "left")
    flag = flag_text(F.col(flag_col))
    return j.select(*requests.columns, flag.alias("flag"), approval_decision(flag).alias("decision"))


def map_actions(df: DataFrame, action_col: str = "action", run_col: str = "run_id") -> DataFrame:
    """Approve/reject action -> sheet flag (an absent action approves); other
    actions, and rows without a run id, are rejected rows."""
    flag = action_to_flag(F.col(action_col))
    error = F.when(flag.isNull(), F.lit("Invalid action"))
    if run_col in df.columns:
        run = F.trim(F.coalesce(F.col(run_col).cast("string"), F.lit("")))
        error = F.when(run == "", F.lit("Missing run_id")).otherwise(error)
    return df.withColumns({"approved_flag": flag, "error": error})


def deployable(gates: DataFrame, approvals: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Candidates that passed the gate AND were approved."""
    a = approvals.select(F.col(run_col).alias("candidate_run_id"), "decision")
    return (gates.join(a, "candidate_run_id", "inner")
            .where(~F.col("skip_deploy") & (F.col("decision") == "APPROVED")))


def approval_links(requests: DataFrame, base_url: str, *, run_col: str = "run_id",
                   model_col: str = "model_name", version_col: str = "model_version") -> DataFrame:
    params = [("run_id", F.col(run_col)), ("model_name", F.col(model_col)),
              ("model_version", F.col(version_col))]
    return requests.select(
        run_col,
        approval_link(base_url, params + [("action", F.lit("APPROVE"))]).alias("approve_url"),
        approval_link(base_url, params + [("action", F.lit("REJECT"))]).alias("reject_url"))
