"""Champion against challenger, both scored on the same rows.

Stored metrics of the champion come from the rows of its own day; a gate that
compares them with a candidate's metrics compares two samples.  Here the model
behind the alias is loaded and scored on the candidate's evaluation rows, next to
the candidate.  The candidate passes with an F1 no smaller; the difference comes
with a paired Poisson bootstrap: every row gets the same Poisson(1) weight for
both models, from a hash of its id, so the interval is repeatable and needs no
resampled copies.

A first run, a model without the alias, and a champion that cannot be loaded
or scored pass, with the reason stated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.hashing import uniform01
from keelson.operators import pipeline
from keelson.operators.registry import DEFAULT_ALIAS, current_aliases
from keelson.session import scratch_path

__all__ = ["model_path", "load_champion", "paired_bootstrap", "gate_rescored"]

REPLICATES = 50
LOW, HIGH = 0.05, 0.95


def model_path(models_dir: str, model_name: str, version: str | int) -> str:
    return f"{models_dir}/{model_name}/v={version}"


def load_champion(spark: SparkSession, models_dir: str, model_name: str, aliases: DataFrame, alias: str = DEFAULT_ALIAS):
    """(version, model, signature) behind the alias; version None without one."""
    row = (current_aliases(aliases).where((F.col("model_name") == model_name) & (F.col("alias") == alias))
           .select("version").first())
    if row is None:
        return None, None, None
    return (row["version"], *pipeline.load_model(spark, model_path(models_dir, model_name, row["version"])))


def _poisson_one(u: Column) -> Column:
    """Poisson(1) by inversion; beyond the table's 12 lies less than 1e-10."""
    steps, total, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= u))


def _f1(true: Column, false_or_missed: Column) -> Column:
    den = 2 * true + false_or_missed
    return F.when(den > 0, 2 * true / den).otherwise(F.lit(0.0))


def paired_bootstrap(scored: DataFrame, id_col: str, label_col: str, new_col: str, old_col: str, *,
                     replicates: int = REPLICATES, seed: int = 42, decimals: int = 6) -> DataFrame:
    """One row: ``new_f1``, ``old_f1``, and the LOW and HIGH quantiles of their
    difference over the replicates (``diff_low``, ``diff_high``).

    Rows are weighted inside the scan and summed per replicate before the shuffle,
    so what is exchanged is a row per replicate and task."""
    positive = F.col(label_col) == 1

    def wins(pred: str) -> tuple[Column, Column]:
        said = F.col(pred) == 1
        return (positive & said).cast("int"), (positive != said).cast("int")

    (tn, fn), (to, fo) = wins(new_col), wins(old_col)
    rows = scored.select(F.col(id_col).cast("string").alias("id"), tn.alias("tn"), fn.alias("fn"), to.alias("to"), fo.alias("fo"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("r"))
    # replicate 0 is the sample itself
    u = uniform01(F.concat_ws("|", "id", F.col("r").cast("string")), f"#{seed}w")
    weight = F.when(F.col("r") == 0, F.lit(1)).otherwise(_poisson_one(u))
    sums = each.groupBy("r").agg(*[F.sum(F.col(c) * weight).alias(c) for c in ("tn", "fn", "to", "fo")])
    f1 = sums.select("r", _f1(F.col("tn"), F.col("fn")).alias("new"), _f1(F.col("to"), F.col("fo")).alias("old"))
    gap = F.when(F.col("r") > 0, F.col("new") - F.col("old"))
    return f1.agg(F.round(F.max(F.when(F.col("r") == 0, F.col("new"))), decimals).alias("new_f1"),
                  F.round(F.max(F.when(F.col("r") == 0, F.col("old"))), decimals).alias("old_f1"),
                  F.round(F.percentile(gap, F.lit(LOW)), decimals).alias("diff_low"),
                  F.round(F.percentile(gap, F.lit(HIGH)), decimals).alias("diff_high"))


def gate_rescored(spark: SparkSession, candidate: PipelineModel, evaluation: DataFrame, *, models_dir: str, model_name: str,
                  aliases: DataFrame, id_col: str, label_col: str, input_cols: Sequence[str], alias: str = DEFAULT_ALIAS,
                  replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """model_name, champion_version, new_f1, old_f1, diff_low, diff_high, improved,
    reason: one row.  ``evaluation`` has one row per id."""
    version, reason = None, None
    path = scratch_path(spark, "rescored")
    wanted = list(dict.fromkeys([id_col, label_col, *input_cols]))
    rows = evaluation.select(*wanted)
    scored = candidate.transform(rows).select(id_col, label_col, *[c for c in input_cols if c not in (id_col, label_col)],
                                              F.col("prediction").cast("int").alias("__new"))
    scored.write.parquet(f"{path}/new")
    scored = spark.read.parquet(f"{path}/new")
    try:
        version, champion, signature = load_champion(spark, models_dir, model_name, aliases, alias)
        if version is None:
            reason = "no champion"
        else:
            both = pipeline.score(champion, signature, scored).select(id_col, label_col, "__new", F.col("prediction").cast("int").alias("__old"))
            both.write.parquet(f"{path}/both")
    except (PySparkException, Py4JJavaError, ValueError) as e:   # the champion is broken: stated, and the candidate passes
        reason = f"champion cannot be scored: {type(e).__name__}"
    result = spark.read.parquet(f"{path}/both") if reason is None else scored.withColumn("__old", F.lit(None).cast("int"))
    sample = paired_bootstrap(result, id_col, label_col, "__new", "__old", replicates=replicates, seed=seed)
    if reason is not None:
        sample = sample.withColumns({c: F.lit(None).cast("double") for c in ("old_f1", "diff_low", "diff_high")})
    return sample.select(F.lit(model_name).alias("model_name"), F.lit(version).cast("string").alias("champion_version"),
                         "new_f1", "old_f1", "diff_low", "diff_high",
                         F.coalesce(F.col("new_f1") >= F.col("old_f1"), F.lit(True)).alias("improved"),
                         F.lit(reason).cast("string").alias("reason"))
