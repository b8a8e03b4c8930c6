"""Corpus pipeline: raw documents to packed training sequences.

1. quality     (op 8)  documents that the quality rules reject go; frequent lines are cut
2. near_copies (op 7)  one document of each group of near copies stays
3. passages    (op 2)  passages that stand in an earlier document are cut
4. mixing      (op 10) sources are replicated to their target weights
5. packing     (op 9)  pieces of the documents in sequences of 2,048 tokens

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of their input.  Each result is
written as Parquet in the shared folder and read back, so a lost executor never
costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import jaccard, mixing, packing, passages, quality
from keelson.llm.queries import tokenizer_path
from keelson.session import prepare, scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.clean_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.keep_one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return passages.remove_passages(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.replicate_to_weights(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("passages", passages_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fuzzy passages and packing are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
