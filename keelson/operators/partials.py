"""Window profiles kept as partial aggregates, merged instead of recomputed.

A refresh reduces its batch to one row per (model, window): counts, and per
feature n, mean, centred second moment, minimum, maximum and a KLL quantile
sketch.  These rows are mergeable, so late or repeated refreshes only add rows for
the windows they touch; raw rows are never read again.  Means and second moments
are merged by the pairwise rule

    M2 = M2a + M2b + (mean_b - mean_a)^2 * na * nb / (na + nb)

which does not cancel as sums of squares do.  Sketches give the window's
distribution: ``sketch_distances`` compares them by population stability and by
the Kolmogorov-Smirnov distance.

A sketch is exact while it holds no more values than its ``k``; beyond that a
rank it returns is off by at most ``rank_error(k)`` (the 99 % bound of the KLL
sketch).  Merged sketches keep the bound of the smallest k among them.

Null and NaN values are counted as nulls and enter no sketch; a null model is a
model of its own; a window without values has null statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.deltas import DeltaLog

__all__ = ["SKETCH_K", "BASELINE_K", "rank_error", "window_partials", "merge_partials", "profile_of", "refresh_profile",
           "read_profile", "merged_sketch", "sketch_distances", "previous_windows"]

SKETCH_K = 1024
BASELINE_K = 4096
GRIDS = (16, 128, 1024)
PSI_BINS = 10
PSI_FLOOR = 1e-6


def rank_error(k: int) -> float:
    """The 99 % bound of a KLL sketch's normalised rank error."""
    return 2.296 / k ** 0.9021


def _value(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def window_partials(mon: DataFrame, feature_cols: Sequence[str], *, ts_col: str = "timestamp",
                    model_col: str = "model_name", pred_col: str = "prediction", granularity: str = "30 minutes",
                    k: int = SKETCH_K) -> DataFrame:
    """One row per (model, window) of ``mon``: mergeable partial aggregates, and
    the window's day for partitioning."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(pred_col).isNull()).alias("n_null_prediction"),
            F.count_if(F.col(pred_col) == 1).alias("n_pred_1"), F.count_if(F.col(pred_col) == 0).alias("n_pred_0")]
    for c in feature_cols:
        v = _value(c)
        aggs += [F.count(v).alias(f"n_{c}"), F.avg(v).alias(f"mean_{c}"), (F.var_pop(v) * F.count(v)).alias(f"m2_{c}"),
                 F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"),
                 F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, k)).alias(f"sketch_{c}")]
    out = mon.groupBy(F.window(ts_col, granularity).alias("w"), F.col(model_col)).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      F.to_date("w.start").alias("day"), *[c for c in out.columns if c != "w"])


def _merged_moments(parts: Column) -> Column:
    """(n, mean, m2) of partial moments, pair by pair."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
                        (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(F.filter(parts, lambda p: p["n"] > 0), zero, add)


def merge_partials(partials: DataFrame, feature_cols: Sequence[str], *, model_col: str = "model_name",
                   k: int = SKETCH_K) -> DataFrame:
    """Partial rows of the same (model, window) as one; what is collected per
    group is one small row per refresh since the last compaction."""
    aggs = [F.sum(c).alias(c) for c in ("n_rows", "n_null_prediction", "n_pred_1", "n_pred_0")]
    for c in feature_cols:
        aggs += [F.sort_array(F.collect_list(F.struct(F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"),
                                                      F.col(f"m2_{c}").alias("m2")))).alias(f"parts_{c}"),
                 F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"),
                 F.when(F.sum(f"n_{c}") > 0, F.kll_merge_agg_double(f"sketch_{c}", k)).alias(f"sketch_{c}")]
    out = partials.groupBy("window_start", "window_end", "day", model_col).agg(*aggs)
    for c in feature_cols:
        m = _merged_moments(F.col(f"parts_{c}"))
        out = (out.withColumn(f"parts_{c}", m).withColumn(f"n_{c}", F.col(f"parts_{c}.n"))
               .withColumn(f"mean_{c}", F.when(F.col(f"n_{c}") > 0, F.col(f"parts_{c}.mean")))
               .withColumn(f"m2_{c}", F.when(F.col(f"n_{c}") > 0, F.col(f"parts_{c}.m2"))))
    return out.select(*partials.columns)


def profile_of(merged: DataFrame, feature_cols: Sequence[str], *, model_col: str = "model_name", decimals: int = 6) -> DataFrame:
    """The columns of ``monitor.window_profile`` from merged partials."""
    cols = ["window_start", "window_end", model_col, "n_rows", "n_null_prediction", "n_pred_1", "n_pred_0"]
    out = []
    for c in feature_cols:
        n = F.col(f"n_{c}")
        out += [(F.col("n_rows") - n).alias(f"n_null_{c}"), F.round(f"mean_{c}", decimals).alias(f"mean_{c}"),
                F.round(F.sqrt(F.when(n > 1, F.col(f"m2_{c}") / (n - 1))), decimals).alias(f"std_{c}"),
                F.col(f"min_{c}"), F.col(f"max_{c}")]
    return merged.select(*cols, *out)


def refresh_profile(log: DeltaLog, batch: int, mon: DataFrame, feature_cols: Sequence[str], *, compact_after: int = 16,
                    **kw) -> None:
    """Commit one refresh: rows for the windows it touches, nothing else."""
    log.commit(batch, window_partials(mon, feature_cols, **kw))
    model_col, k = kw.get("model_col", "model_name"), kw.get("k", SKETCH_K)
    log.compact(lambda rows: merge_partials(rows, feature_cols, model_col=model_col, k=k), compact_after)


def read_profile(log: DeltaLog, feature_cols: Sequence[str], *, model_col: str = "model_name", k: int = SKETCH_K) -> DataFrame:
    """All windows of a state, merged."""
    return merge_partials(log.read().drop("commit"), feature_cols, model_col=model_col, k=k)


# ------------------------------------------------------------------ distances

def merged_sketch(windows: DataFrame, feature: str, *, model_col: str = "model_name", k: int = BASELINE_K) -> DataFrame:
    """(model, n, sketch) over the given windows: a baseline made of sketches."""
    has = windows.where(F.col(f"sketch_{feature}").isNotNull())
    return has.groupBy(model_col).agg(F.sum(f"n_{feature}").alias("n"), F.kll_merge_agg_double(f"sketch_{feature}", k).alias("sketch"))


def previous_windows(windows: DataFrame, feature: str, *, model_col: str = "model_name", minutes: int = 30) -> DataFrame:
    """(model, window_start, n, sketch): each window as the reference of the one behind it."""
    return windows.where(F.col(f"sketch_{feature}").isNotNull()).select(
        model_col, (F.col("window_start") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("window_start"),
        F.col(f"n_{feature}").alias("n"), F.col(f"sketch_{feature}").alias("sketch"))


def _quantiles(sketch: Column, n: Column, k: int) -> Column:
    """The values at ranks 1/g .. g/g, on a grid g of the window's size class: a
    sketch takes constant ranks only.  Up to g values it holds every one of them."""
    grids = [g for g in GRIDS if g < k] + [k]
    out = None
    for g in grids:
        q = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / g) for i in range(1, g + 1)]))
        if g == k:
            return q if out is None else out.otherwise(q)
        out = F.when(n <= g, q) if out is None else out.when(n <= g, q)


def _steps(quantiles: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, values up to each) of n values, from their quantiles."""
    g = len(quantiles)
    last = np.flatnonzero(np.concatenate([quantiles[1:] != quantiles[:-1], [True]]))
    return quantiles[last], np.minimum(n, np.ceil((last + 1) * n / g - 1e-9))


def _psi(p: np.ndarray, q: np.ndarray, slack_p: float, slack_q: float, floor: float) -> tuple[float, float, float]:
    """PSI, and the least and largest PSI of shares within the slacks of p and q:
    a term grows with the distance of its two shares, so the bounds lie at the
    nearest and the farthest corners."""
    def term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.maximum(a, floor), np.maximum(b, floor)
        return (b - a) * np.log(b / a)

    near = np.abs(q - p) <= slack_p + slack_q
    low_p = np.where(near, q, np.where(q > p, p + slack_p, p - slack_p))
    low_q = np.where(near, q, np.where(q > p, q - slack_q, q + slack_q))
    up_p, up_q = np.maximum(p - slack_p, 0.0), np.minimum(q + slack_q, 1.0)
    down_p, down_q = np.minimum(p + slack_p, 1.0), np.maximum(q - slack_q, 0.0)
    high = np.maximum(term(up_p, up_q), term(down_p, down_q))
    return float(term(p, q).sum()), float(term(low_p, low_q).sum()), float(high.sum())


def _distance_batches(k: int, reference_k: int, bins: int, floor: float) -> Callable:
    def error(n: int, size: int) -> float:
        return rank_error(size) + 1.0 / size if n > size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                n, n_ref = batch.column("n")[i].as_py(), batch.column("n_reference")[i].as_py()
                if not n or not n_ref:
                    out.append((None,) * 5)
                    continue
                v, c = _steps(np.asarray(batch.column("q")[i].values), n)
                rv, rc = _steps(np.asarray(batch.column("q_reference")[i].values), n_ref)

                def share(x: np.ndarray, values: np.ndarray, upto: np.ndarray, of: int) -> np.ndarray:
                    return np.concatenate([[0.0], upto])[np.searchsorted(values, x, "right")] / of

                # both are steps, so they differ most at a step of one of them
                at = np.concatenate([v, rv])
                ks = float(np.abs(share(at, v, c, n) - share(at, rv, rc, n_ref)).max())
                edges = rv[np.searchsorted(rc, np.ceil(np.arange(1, bins) / bins * n_ref))]
                p, q = (np.diff(np.concatenate([[0.0], share(edges, *side), [1.0]])) for side in ((rv, rc, n_ref), (v, c, n)))
                e, e_ref = error(n, k), error(n_ref, reference_k)
                out.append((*_psi(p, q, 2 * e_ref, 2 * e, floor), ks, e + e_ref))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("model", "window_start", "n", "n_reference")] + [pa.array(c, pa.float64()) for c in cols],
                names=["model", "window_start", "n", "n_reference", "psi", "psi_low", "psi_high", "ks", "ks_error"])
    return run


def sketch_distances(windows: DataFrame, reference: DataFrame, feature: str, *, model_col: str = "model_name",
                     by_window: bool = False, k: int = SKETCH_K, reference_k: int = BASELINE_K, bins: int = PSI_BINS,
                     floor: float = PSI_FLOOR, decimals: int = 6) -> DataFrame:
    """Each window against its reference sketch: one per model, or with
    ``by_window`` one per (model, window_start).

    ``psi`` over the reference's quantile bins with its bounds ``psi_low`` and
    ``psi_high``; ``ks`` with its bound ``ks_error``.  The bounds are zero where both
    sketches are exact.  Every window has a row; without values on either side
    the statistics are null.  Sketches are joined, a row per window; their
    quantiles are compared in Arrow batches."""
    keys = [model_col] + (["window_start"] if by_window else [])
    n = F.col(f"n_{feature}")
    w = windows.select(F.col(model_col).alias("model"), "window_start", n.alias("n"),
                       F.when(n > 0, _quantiles(F.col(f"sketch_{feature}"), n, k)).alias("q"))
    r = reference.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("n").alias("n_reference"),
                         _quantiles(F.col("sketch"), F.col("n"), reference_k).alias("q_reference"))
    same = F.col("model").eqNullSafe(F.col(f"__{model_col}"))
    if by_window:
        same = same & (F.col("window_start") == F.col("__window_start"))
    kind = windows.schema[model_col].dataType.simpleString()
    met = w.join(r, same, "left").select("model", "window_start", "n", F.coalesce("n_reference", F.lit(0)).cast("long").alias("n_reference"),
                                         "q", "q_reference")
    out = met.mapInArrow(_distance_batches(k, reference_k, bins, floor),
                         f"model {kind}, window_start timestamp, n long, n_reference long, psi double, psi_low double, "
                         "psi_high double, ks double, ks_error double")
    return out.select(F.col("model").alias(model_col), "window_start", F.col("n").alias("n_values"), "n_reference",
                      *[F.round(c, decimals).alias(c) for c in ("psi", "psi_low", "psi_high", "ks", "ks_error")])
