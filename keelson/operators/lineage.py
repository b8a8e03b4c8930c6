"""Lineage closure: everything a run was made from.

``inputs`` says which table versions a run read, ``derived`` from which other
versions a version was made.  Ancestors are found step by step: each step joins
the nodes found last to their sources and keeps what is new, so a cycle ends and
a node reached on many ways is followed once.  Steps are written to the shared
folder; their number is the depth of the graph, not its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_path

__all__ = ["ancestors"]


def ancestors(inputs: DataFrame, derived: DataFrame) -> DataFrame:
    """(run_id, node, distance) for inputs (run_id, node) and derived (node,
    source): every node the run depends on, with the fewest steps to it.  Rows
    with a null are no links."""
    spark = inputs.sparkSession
    path = scratch_path(spark, "lineage")
    links = derived.where("node is not null and source is not null").select("node", "source").distinct()
    links.write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    step = 0
    front = inputs.where("run_id is not null and node is not null").select("run_id", "node").distinct()
    while True:
        front.withColumn("distance", F.lit(step)).write.parquet(f"{path}/found/step={step}")
        found = spark.read.parquet(f"{path}/found").select("run_id", "node", "distance")
        last = found.where(F.col("distance") == step)
        if last.isEmpty():
            return found
        onward = last.join(links, "node").select("run_id", F.col("source").alias("node")).distinct()
        front = onward.join(found.select("run_id", "node"), ["run_id", "node"], "left_anti")
        step += 1
