"""Connected components of a link table, without driver-side state.

Alternating large-star and small-star passes (each an aggregation and a join)
until the links are a forest of stars.  Every pass is written to the shared
scratch folder, so lineage stays short and a lost executor costs one pass; the
driver sees one checksum row per pass.  Both passes pre-aggregate the minimum
per node, so a node with very many links is no hot task of the aggregation, and
the join back is an ordinary one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_path

__all__ = ["connected_components"]


def _pass(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = both.groupBy("n").agg(F.least(F.col("n"), F.min("w")).alias("m"))
    large = (both.where("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
             .where("u > v").groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v")
            .groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v"))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (long columns a, b):
    component is the smallest node reachable.  Self links and nulls drop out."""
    spark = links.sparkSession
    path = scratch_path(spark, "components")
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("a is not null and b is not null").where("u > v").distinct())
    step, seen = 0, None
    while True:
        edges.write.parquet(f"{path}/{step}")
        edges = spark.read.parquet(f"{path}/{step}")
        now = _checksum(edges)
        if now == seen:
            break
        seen, step = now, step + 1
        edges = _pass(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
