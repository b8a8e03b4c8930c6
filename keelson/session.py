"""Session helpers: configuration defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults a Spark user would set for this workload.  Only applied when the
# caller builds the session through ``build_session``; of an existing session only
# the time zone (results are defined in UTC) and an unset size of Arrow batches
# are set.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, app_name: str = "keelson",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC, bound Arrow batches and make sure a checkpoint folder exists.

    The cluster names its shared folder in ``spark.checkpoint.dir``; we read it
    from the session and only fall back to a local folder when it is unset
    (local tests)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.getConf().get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, "4m")    # a task holds a few batches of long texts, in the JVM and in Python
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by executors: refuse rather
            # than write checkpoints that other machines cannot read back
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by the "
                               "cluster (checkpoints, stream sinks and scratch tables go there)")
        configured = tempfile.mkdtemp(prefix="keelson-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def landed(df: DataFrame, name: str) -> DataFrame:
    """A small side written to the scratch folder and read back: joins then see
    its measured size, so a small one is broadcast without shuffling the large
    side and a big one goes to a sort-merge join that AQE can split."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose data has been used up.  Only folders that
    ``scratch_path`` names are deleted."""
    root = os.path.join(checkpoint_dir(spark), "keelson") + "/"
    if not path.startswith(root) or not path[len(root):].strip("/.") or ".." in path[len(root):]:
        raise ValueError(f"not a scratch folder: {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "keelson", f"{name}-{uuid.uuid4().hex[:12]}")
