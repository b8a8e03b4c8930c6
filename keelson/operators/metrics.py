"""Aggregations: counts, frequencies, profiles, classification metrics, AUC.

All are hash aggregates with map-side partial aggregation; none uses a
global window.  Denominators over the whole input are scalar subqueries
(computed once, inlined as a value) rather than ``sum() OVER ()``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordered import running_totals
from keelson.session import landed

__all__ = [
    "value_counts", "value_freqs", "distinct_count", "numeric_profile", "confusion_counts",
    "classification_metrics", "confusion_matrix", "roc_auc", "split_counts", "log_loss", "evaluation_bundle",
]


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_col))


def value_freqs(df: DataFrame, col: str, decimals: int | None = 6) -> DataFrame:
    """Normalised frequencies (nulls excluded from numerator and denominator)."""
    counts = value_counts(df, col)
    total = df.where(F.col(col).isNotNull()).select(F.count(F.lit(1))).scalar()
    freq = F.col("n") / total
    return counts.withColumn("freq", F.round(freq, decimals) if decimals is not None else freq)


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias(f"n_distinct_{col}"))


def numeric_profile(df: DataFrame, numeric_cols: Sequence[str], range_cols: Sequence[str] = (),
                    group_cols: Sequence[str] = (), decimals: int = 6) -> DataFrame:
    """Row count, mean and sample std of numerics; min / max of ranges (dates)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in numeric_cols:
        aggs += [F.round(F.avg(c), decimals).alias(f"mean_{c}"),
                 F.round(F.stddev_samp(c), decimals).alias(f"std_{c}")]
    for c in range_cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*group_cols).agg(*aggs)


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     group_cols: Sequence[str] = (), positive: int = 1) -> DataFrame:
    y = F.col(label_col) == positive
    p = F.col(pred_col) == positive
    return df.groupBy(*group_cols).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _safe_div(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                           group_cols: Sequence[str] = (), decimals: int | None = 6) -> DataFrame:
    """Binary accuracy / precision / recall / F1 (positive = 1); a metric whose
    denominator is 0 is 0.  One pass: four conditional counts."""
    c = confusion_counts(df, label_col, pred_col, group_cols)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    metrics = {
        "accuracy": _safe_div(tp + tn, tp + fp + fn + tn),
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "f1": _safe_div(2 * tp, 2 * tp + fp + fn),
    }
    if decimals is not None:
        metrics = {k: F.round(v, decimals) for k, v in metrics.items()}
    return c.withColumns(metrics)


def confusion_matrix(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*group_cols, F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def roc_auc(df: DataFrame, label_col: str = "label", score_col: str = "score",
            group_cols: Sequence[str] = (), decimals: int | None = 6, buckets: int | None = None) -> DataFrame:
    """ROC-AUC by the Mann-Whitney rank sum, ties counted half.

    Rows are first reduced to one row per distinct (group, score) with
    positive / negative counts, then a distributed running total of negatives
    gives, for every score, the negatives ranked below it."""
    g = list(group_cols)
    per_score = (df.where(F.col(score_col).isNotNull() & F.col(label_col).isin(0, 1))
                 .groupBy(*g, score_col)
                 .agg(F.count_if(F.col(label_col) == 1).alias("pos"),
                      F.count_if(F.col(label_col) == 0).alias("neg")))
    cum = running_totals(per_score, [score_col], ["neg"], g, buckets=buckets)
    contrib = F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)
    agg = cum.groupBy(*g).agg(F.sum(contrib).alias("u"), F.sum("pos").alias("n_pos"),
                             F.sum("neg").alias("n_neg"))
    auc = F.when(F.col("n_pos") * F.col("n_neg") > 0, F.col("u") / (F.col("n_pos") * F.col("n_neg")))
    return agg.select(*g, "n_pos", "n_neg",
                      (F.round(auc, decimals) if decimals is not None else auc).alias("auc"))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def log_loss(df: DataFrame, label_col: str = "label", prob_col: str = "probability",
             group_cols: Sequence[str] = (), eps: float = 1e-15, decimals: int | None = 6) -> DataFrame:
    """Mean binary cross-entropy, probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(prob_col), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label_col).cast("double")
    term = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    ll = F.avg(term)
    return df.where(F.col(prob_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), (F.round(ll, decimals) if decimals is not None else ll).alias("log_loss"))


def evaluation_bundle(df: DataFrame, label_col: str = "label", pred_col: str = "prediction", score_col: str = "score",
                      prob_col: str = "probability", group_cols: Sequence[str] = (), *, eps: float = 1e-15,
                      decimals: int = 6) -> DataFrame:
    """accuracy, precision, recall, f1_score, roc_auc and log_loss per group, from
    one pass over the scored rows: they are reduced to counts per (group, label,
    prediction, score, probability) and landed; everything else reads the counts.

    A metric whose denominator is 0 is 0; AUC needs rows of both labels and
    log-loss rows with a label and a probability, else they are null."""
    g = list(group_cols)
    counts = landed(df.groupBy(*g, F.col(label_col).alias("__y"), F.col(pred_col).alias("__p"), F.col(score_col).alias("__s"),
                               F.col(prob_col).cast("double").alias("__q")).agg(F.count(F.lit(1)).alias("__n")), "scored_counts")
    n, y, p = F.col("__n"), F.col("__y") == 1, F.col("__p") == 1
    clipped = F.least(F.greatest(F.col("__q"), F.lit(eps)), F.lit(1 - eps))
    known = F.col("__q").isNotNull() & F.col("__y").isNotNull()
    label = F.col("__y").cast("double")
    term = -(label * F.log(clipped) + (1.0 - label) * F.log(1.0 - clipped))

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    sums = counts.groupBy(*g).agg(total(y & p).alias("tp"), total(~y & p).alias("fp"), total(y & ~p).alias("fn"), total(~y & ~p).alias("tn"),
                                  F.sum(F.when(known, n * term)).alias("__loss"), F.sum(F.when(known, n)).alias("__known"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sums = sums.select(*g, F.round(_safe_div(tp + tn, tp + fp + fn + tn), decimals).alias("accuracy"),
                       F.round(_safe_div(tp, tp + fp), decimals).alias("precision"), F.round(_safe_div(tp, tp + fn), decimals).alias("recall"),
                       F.round(_safe_div(2 * tp, 2 * tp + fp + fn), decimals).alias("f1_score"),
                       F.round(F.col("__loss") / F.col("__known"), decimals).alias("log_loss"))
    per_score = (counts.where(F.col("__s").isNotNull() & F.col("__y").isin(0, 1)).groupBy(*g, "__s")
                 .agg(total(F.col("__y") == 1).alias("pos"), total(F.col("__y") == 0).alias("neg")))
    cum = running_totals(per_score, ["__s"], ["neg"], g)
    u = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5))
    pairs = F.sum("pos") * F.sum("neg")
    auc = cum.groupBy(*g).agg(F.round(F.when(pairs > 0, u / pairs), decimals).alias("roc_auc"))
    if not g:
        return sums.join(F.broadcast(auc))               # one row each
    a = auc.select(*[F.col(c).alias(f"__{c}") for c in g], "roc_auc")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g]
    return sums.join(a, same, "left").select(*sums.columns, "roc_auc")
