"""Registered model-training queries (rows-only check: tree scores differ by
trainer, so only the shape and row count are compared)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import encode, metrics, split, train
from keelson.plans.queries import T, query
from keelson.session import scratch_path


def _labeled(spark, d):
    """All documents; ``quality`` is null without a label."""
    docs = T(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return docs.join(T(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


_STORED: dict[tuple[str, str], str] = {}


def _fit(spark, d):
    """The model, fitted once per session and table folder and then loaded, and
    the encoded rows."""
    from pyspark.ml.classification import GBTClassificationModel
    lab = _labeled(spark, d)
    s = split.assign_split(lab, "doc_id", 0.2, 42)
    tr = s.where((F.col("split") == "train") & F.col("quality").isNotNull())
    codes = encode.fit_category_map(tr, "lang")
    enc = encode.apply_category_map(s, "lang", codes).withColumn("lang_code", F.col("lang_code").cast("double"))
    known = enc.where((F.col("split") == "train") & F.col("quality").isNotNull())
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        model, path = train.fit_gbt(known, ["lang_code", "n_chars"], "quality"), scratch_path(spark, "gbt")   # 200 trees of depth 6
        model.write().save(path)
        _STORED[key] = path
    return GBTClassificationModel.load(_STORED[key]), enc


@query("gbt_scores")
def q_gbt_scores(spark, d):
    model, enc = _fit(spark, d)
    return train.score_gbt(model, enc, ["lang_code", "n_chars"], ["doc_id", "split"])


@query("gbt_metrics")
def q_gbt_metrics(spark, d):
    model, enc = _fit(spark, d)
    scored = train.score_gbt(model, enc.where((F.col("split") == "test") & F.col("quality").isNotNull()), ["lang_code", "n_chars"],
                             ["doc_id", "quality"])
    return metrics.classification_metrics(scored, "quality", "prediction")
