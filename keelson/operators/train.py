"""Classifier fit / batch scoring on Spark ML, plus a hook for Python models.

The original trains a boosted-tree classifier in one process; here it is
``pyspark.ml.classification.GBTClassifier`` (distributed; quality-level
match, not score-level).  ``score_with`` runs any Python model per Arrow
batch with ``mapInPandas`` -- the one place user code runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.encode import assemble

__all__ = ["GBT_DEFAULTS", "fit_gbt", "score_gbt", "score_with"]

# --- fixed values of the original training configuration ---
GBT_DEFAULTS = {"learning_rate": 0.05, "n_estimators": 200, "max_depth": 6}
# --- end of fixed values ---


def fit_gbt(train: DataFrame, feature_cols: Sequence[str], label_col: str,
            params: Mapping[str, float] | None = None, seed: int = 42):
    from pyspark.ml.classification import GBTClassifier
    p = {**GBT_DEFAULTS, **(params or {})}
    data = assemble(train, feature_cols).select("features", F.col(label_col).cast("double").alias("label"))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", stepSize=float(p["learning_rate"]),
                        maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), seed=seed)
    data = data.persist()
    try:
        return gbt.fit(data)
    finally:
        data.unpersist()


def score_gbt(model, df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    out = model.transform(assemble(df, feature_cols))
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      F.round(vector_to_array("probability")[1], 6).alias("p1"))


def score_with(df: DataFrame, load_model: Callable[[], object], feature_cols: Sequence[str],
               keep: Sequence[str], output_schema: str) -> DataFrame:
    """Apply ``load_model().predict(frame)`` to each Arrow batch (model loaded
    once per task)."""
    feature_cols, keep = list(feature_cols), list(keep)

    def run(batches):
        model = load_model()
        for pdf in batches:
            pred = model.predict(pdf[feature_cols])
            yield pd.DataFrame({**{k: pdf[k] for k in keep}, "prediction": pred})

    return df.select(*keep, *[c for c in feature_cols if c not in keep]).mapInPandas(run, output_schema)
