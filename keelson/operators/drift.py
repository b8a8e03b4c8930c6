"""Distribution drift between a baseline and a current sample, per group.

* PSI and Jensen-Shannon on fixed-width bins (edges from the baseline range);
* two-sample Kolmogorov-Smirnov on the exact empirical CDFs.

Both sides are reduced by hash aggregates first (bin counts; counts per
distinct value), KS then uses the distributed running totals, so a group with
a third of all rows never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordered import running_totals

__all__ = ["binned_divergence", "ks_statistic"]


def _bin_of(value, lo, hi, bins: int):
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor((value - lo) / width)
    b = F.when(hi > lo, F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    return b.cast("int")


def _group_name(group_cols: Sequence[str]):
    """One non-null column per group (null keys included)."""
    return F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}) if group_cols else F.lit("")


def _value_counts(baseline: DataFrame, current: DataFrame, value_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Both samples reduced to counts per (group, distinct value) in one
    aggregate over the tagged union: ``nb`` baseline rows, ``nc`` current rows.
    Null values stay as a row, so a group without any value is still seen."""
    side = [*group_cols, value_col]
    tagged = (baseline.select(*side, F.lit(True).alias("__b"))
              .unionByName(current.select(*side, F.lit(False).alias("__b"))))
    return (tagged.groupBy(*side).agg(F.count_if(F.col("__b")).alias("nb"), F.count_if(~F.col("__b")).alias("nc"))
            .withColumn("__group", _group_name(group_cols)))


def _totals(per_value: DataFrame, value_col: str, group_cols: Sequence[str]) -> DataFrame:
    """Rows with a value per group and side, and the baseline's range."""
    has = F.col(value_col).isNotNull()
    in_base = F.when(has & (F.col("nb") > 0), F.col(value_col))
    return per_value.groupBy("__group", *group_cols).agg(
        F.coalesce(F.sum(F.when(has, F.col("nb"))), F.lit(0)).alias("n_baseline"),
        F.coalesce(F.sum(F.when(has, F.col("nc"))), F.lit(0)).alias("n_current"),
        F.min(in_base).alias("__lo"), F.max(in_base).alias("__hi"))


def binned_divergence(baseline: DataFrame, current: DataFrame, value_col: str,
                      group_cols: Sequence[str] = (), *, bins: int = 10, floor: float = 1e-6,
                      decimals: int = 6) -> DataFrame:
    """PSI = sum (q - p) ln(q / p);  JS = (KL(p||m) + KL(q||m)) / 2, m = (p+q)/2.

    Proportions below ``floor`` are raised to it.  Bins are equal-width over
    the baseline's [min, max] per group; values outside fall in the end bins.
    Every group of either side has a row; without values on both sides its
    counts stand with null statistics.  The raw rows are read once per side:
    ranges and bins work on the counts per distinct value."""
    g = list(group_cols)
    per_value = _value_counts(baseline, current, value_col, g)
    total = _totals(per_value, value_col, g)
    v = F.col(value_col)
    binned = (per_value.where(v.isNotNull()).select("__group", value_col, "nb", "nc")
              .join(total.select("__group", "__lo", "__hi"), "__group")
              .groupBy("__group", _bin_of(v, F.col("__lo"), F.col("__hi"), bins).alias("bin"))
              .agg(F.sum("nb").alias("__b"), F.sum("nc").alias("__c")))
    # at most ``bins`` entries per group; absent bins count zero
    counts = binned.groupBy("__group").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("__b", "__c")))).alias("__bins"))
    j = total.join(counts, "__group", "left")

    def share(field: str, n: str):
        def of(i):
            return F.greatest(F.coalesce(F.try_element_at("__bins", i)[field], F.lit(0)) / F.col(n), F.lit(floor))
        return of

    p, q = share("__b", "n_baseline"), share("__c", "n_current")
    grid = F.sequence(F.lit(0), F.lit(bins - 1))

    def total_of(term):
        terms = F.transform(grid, lambda i: term(p(i), q(i)))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def js(a, b):
        m = (a + b) / 2
        return 0.5 * (a * F.log(a / m) + b * F.log(b / m))

    both = (F.col("n_baseline") > 0) & (F.col("n_current") > 0)
    return j.select(*g, "n_baseline", "n_current",
                    F.when(both, F.round(total_of(lambda a, b: (b - a) * F.log(b / a)), decimals)).alias("psi"),
                    F.when(both, F.round(total_of(js), decimals)).alias("js"))


def ks_statistic(baseline: DataFrame, current: DataFrame, value_col: str,
                 group_cols: Sequence[str] = (), *, decimals: int = 6, buckets: int | None = None) -> DataFrame:
    """D = max_x |F_baseline(x) - F_current(x)| per group (exact, ties grouped).
    Every group of either side has a row; the statistic is null without values
    on both sides."""
    g = list(group_cols)
    per_value = _value_counts(baseline, current, value_col, g)
    total = _totals(per_value, value_col, g).drop("__lo", "__hi")
    cum = running_totals(per_value.where(F.col(value_col).isNotNull()).withColumnRenamed("__group", "__name"),
                         [value_col], ["nb", "nc"], ["__name"], buckets=buckets)
    gap = F.abs(F.col("cum_nb") / F.col("n_baseline") - F.col("cum_nc") / F.col("n_current"))
    both = (F.col("n_baseline") > 0) & (F.col("n_current") > 0)
    worst = (cum.withColumnRenamed("__name", "__group").join(total.select("__group", "n_baseline", "n_current"), "__group")
             .where(both).groupBy("__group").agg(F.max(gap).alias("__gap")))
    return total.join(worst, "__group", "left").select(
        *g, "n_baseline", "n_current", F.round("__gap", decimals).alias("ks"))
