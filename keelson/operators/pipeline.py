"""Category codes, assembly and classifier as one Spark ML pipeline that can be
stored and loaded.

``CategoryCodes`` fits the maps of ``encode.fit_category_map``; its model keeps
them as a table, so a column of any cardinality is joined and nothing passes
through the driver.  A stored model is a folder: the pipeline, and the signature
of its input columns, checked before it scores.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators.encode import UNSEEN, fit_category_map
from keelson.session import landed
from keelson.sources.tables import check_signature, schema_json

__all__ = ["CategoryCodes", "CategoryCodesModel", "classifier_pipeline", "save_model", "load_model", "score"]


class CategoryCodes(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Codes 0..k-1 of the sorted distinct non-null values of every input column;
    unseen and null values get -1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CategoryCodesModel:
        maps = [fit_category_map(dataset.select(F.col(c).cast("string").alias("value")), "value").select(F.lit(c).alias("column"), "value", "code")
                for c in self.getInputCols()]
        codes = landed(reduce(DataFrame.unionByName, maps), "category_codes")
        return self._copyValues(CategoryCodesModel(codes))


class _CodesWriter(MLWriter):
    def __init__(self, instance: CategoryCodesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.codes.write.parquet(f"{path}/codes")


class _CodesReader(MLReader):
    def load(self, path: str) -> CategoryCodesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CategoryCodesModel(self.sparkSession.read.parquet(f"{path}/codes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class CategoryCodesModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """``codes`` has a row (column, value, code) per fitted value."""

    def __init__(self, codes: DataFrame | None = None):
        super().__init__()
        self.codes = codes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, out in zip(self.getInputCols(), self.getOutputCols()):
            m = self.codes.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
            dataset = (dataset.join(m, F.col(c).cast("string") == F.col("__value"), "left")
                       .withColumn(out, F.coalesce("__code", F.lit(UNSEEN)).cast("double")).drop("__value", "__code"))
        return dataset

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


def classifier_pipeline(cat_cols: Sequence[str], num_cols: Sequence[str], label_col: str,
                        params: Mapping[str, float] | None = None, seed: int = 42) -> Pipeline:
    """Codes -> assembler -> boosted trees, unfitted."""
    from pyspark.ml.classification import GBTClassifier

    from keelson.operators.train import GBT_DEFAULTS
    p = {**GBT_DEFAULTS, **(params or {})}
    coded = [f"{c}_code" for c in cat_cols]
    stages = [CategoryCodes(inputCols=list(cat_cols), outputCols=coded)] if cat_cols else []
    return Pipeline(stages=[*stages,
                            VectorAssembler(inputCols=[*coded, *num_cols], outputCol="features", handleInvalid="keep"),
                            GBTClassifier(featuresCol="features", labelCol=label_col, stepSize=float(p["learning_rate"]),
                                          maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), seed=seed)])


def save_model(model: PipelineModel, path: str, sample: DataFrame, input_cols: Sequence[str]) -> None:
    """The pipeline and the signature of its input columns (names and types of
    ``sample``); a folder of this name is replaced."""
    spark = sample.sparkSession
    model.write().overwrite().save(f"{path}/pipeline")
    row = spark.createDataFrame([(schema_json(sample, list(input_cols)),)], "signature string")
    row.write.mode("overwrite").parquet(f"{path}/signature")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, str]:
    """(pipeline, signature) of a stored model."""
    signature = spark.read.parquet(f"{path}/signature").first()["signature"]
    return PipelineModel.load(f"{path}/pipeline"), signature


def score(model: PipelineModel, signature: str, df: DataFrame) -> DataFrame:
    """``model`` on ``df``, once its columns agree with the signature."""
    return model.transform(check_signature(df, signature))
