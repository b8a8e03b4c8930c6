"""State tables kept as deltas: a refresh writes what it brings, not the whole state.

A state is a folder of commits.  Commit ``d<batch>`` holds the rows of one
batch, commit ``b<batch>`` the fold of everything up to it.  A manifest row is
appended after a commit's data, so half-written commits are invisible; a batch
that is replayed overwrites its own commit and reads only commits before it, so a
replay changes nothing.  Commits may be partitioned (by a hash bucket of the
key, or a day): a look-up that filters the partition column by literals reads
those folders only.

Readers fold what they read (latest row per key, sum of partial counts, ...);
``compact`` writes that fold as the next base, so a read covers one base and the
deltas since.  A log whose fold is "latest row per key" stores its key and order
columns beside the manifest, so ``DeltaLog.open`` can read it without them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.sources.tables import table_exists

__all__ = ["DeltaLog"]


KEY_BUCKETS = 64


class DeltaLog:
    """A folder of commits; ``partition_by`` names columns of every commit.

    With ``key``, rows of one key are folded to the latest by ``order`` (all stay
    without an order), and commits are partitioned by a hash bucket of the key."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = (), *, key: Sequence[str] = (),
                 order: Sequence[str] = ()):
        self.spark, self.path, self.key, self.order = spark, path, list(key), list(order)
        self.partition_by = list(partition_by) or (["key_bucket"] if self.key else [])
        self._manifest = os.path.join(path, "_manifest")
        self._about = os.path.join(path, "_about")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DeltaLog | None:
        """The log at ``path`` as it was described there, if there is one."""
        if not table_exists(spark, os.path.join(path, "_manifest")):
            return None
        about = json.loads(spark.read.parquet(os.path.join(path, "_about")).first()["about"])
        return cls(spark, path, about["partition_by"], key=about["key"], order=about["order"])

    def _commits(self, before: int | None) -> tuple[int | None, list[int]]:
        """The newest base and the deltas behind it, of commits before ``before``."""
        if not table_exists(self.spark, self._manifest):
            return None, []
        rows = self.spark.read.parquet(self._manifest).distinct()
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        listed = rows.collect()                           # one row per commit
        base = max((r["batch"] for r in listed if r["kind"] == "b"), default=None)
        return base, sorted(r["batch"] for r in listed if r["kind"] == "d" and (base is None or r["batch"] > base))

    def _folder(self, kind: str, batch: int) -> str:
        return os.path.join(self.path, f"commit={kind}{batch}")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        if self.key and "key_bucket" in self.partition_by:
            return df.withColumn("key_bucket", F.pmod(F.xxhash64(*self.key), F.lit(KEY_BUCKETS)).cast("int"))
        return df

    def _write(self, kind: str, batch: int, df: DataFrame) -> None:
        if not table_exists(self.spark, self._about):
            about = json.dumps({"partition_by": self.partition_by, "key": self.key, "order": self.order})
            self.spark.createDataFrame([(about,)], "about string").write.mode("overwrite").parquet(self._about)
        w = self._bucketed(df)
        if self.partition_by:
            w = w.hint("rebalance", *self.partition_by)
        w = w.write.mode("overwrite")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(self._folder(kind, batch))
        row = self.spark.createDataFrame([(kind, int(batch))], "kind string, batch long")
        row.write.mode("append").parquet(self._manifest)

    def commit(self, batch: int, df: DataFrame) -> None:
        """The rows of one batch; committing a batch again replaces them."""
        self._write("d", batch, df)

    def read(self, before: int | None = None) -> DataFrame | None:
        """All rows of the newest base and the deltas behind it, with a string
        column ``commit``; None where nothing is committed.  ``before`` leaves out
        commits of that batch and later ones."""
        base, deltas = self._commits(before)
        folders = ([] if base is None else [self._folder("b", base)]) + [self._folder("d", b) for b in deltas]
        if not folders:
            return None
        # the schema of the first commit holds for all; no file is sampled for it
        kinds = self.spark.read.option("basePath", self.path).parquet(folders[0]).schema
        kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name == "commit" else f.dataType) for f in kinds])
        return self.spark.read.schema(kinds).option("basePath", self.path).parquet(*folders)

    def latest(self, before: int | None = None) -> DataFrame | None:
        """One row per key (the latest by ``order``), without bookkeeping columns."""
        rows = self.read(before)
        if rows is None:
            return None
        return self._folded(rows.drop("commit", "key_bucket"))

    def _folded(self, rows: DataFrame) -> DataFrame:
        if not (self.key and self.order):
            return rows
        cols = [c for c in rows.columns if c not in self.key]
        newest = F.max_by(F.struct(*cols), F.struct(*self.order)).alias("__row")
        return rows.groupBy(*self.key).agg(newest).select(*self.key, *[F.col(f"__row.{c}").alias(c) for c in cols])

    def of_keys(self, keys: DataFrame, before: int | None = None) -> DataFrame | None:
        """Stored rows in the buckets of ``keys``: its bucket numbers (at most
        KEY_BUCKETS) become literals, so other folders are not read."""
        rows = self.read(before)
        if rows is None:
            return None
        buckets = [r[0] for r in self._bucketed(keys.select(*self.key)).select("key_bucket").distinct().collect()]
        return rows.where(F.col("key_bucket").isin(buckets)).drop("commit", "key_bucket")

    def n_deltas(self) -> int:
        return len(self._commits(None)[1])

    def compact(self, fold: Callable[[DataFrame], DataFrame] | None = None, after: int = 1) -> bool:
        """Write the fold of everything (the latest row per key, by default) as the
        next base, once ``after`` deltas have gathered behind the last one."""
        _, deltas = self._commits(None)
        if len(deltas) < after:
            return False
        rows = self.read().drop("commit")
        self._write("b", deltas[-1], fold(rows) if fold else self._folded(rows.drop("key_bucket")))
        return True
