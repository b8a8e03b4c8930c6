"""Mixing sources to target weights (op 10): Poisson replication.

Every source gets a mean repetition rate, ``target share * budget / size of the
source``; every document gets a Poisson number of copies with that mean, drawn
by inverting the distribution at a uniform number hashed from (doc_id, seed).
The copies are dealt out by a hash of (doc_id, copy, seed), which is a global
shuffle.  Draws depend on keys only, so a recomputed partition gives the same
rows on any cluster.

DataFrame and SQL functions only.  Sizes are pre-aggregated per source; the
table of rates has one row per source and is written and read back, so its
measured size decides between a broadcast and a sort-merge join (whose hot
sources adaptive execution splits).  Only the copies are shuffled, by a random
key, so no source makes a hot partition.

Edge cases: a null source is a source of its own; null or empty text has size
0 and is drawn like the rest of its source; a source of size 0 or without a
weight has rate 0, and its documents get no copy; rows of one doc_id
draw alike, and so do rows without a doc_id that have the same text; an empty table gives an empty result; further columns are carried
along (``copy`` and ``shuffle_key`` of the result win over clashing names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import uniform01
from keelson.session import scratch_path

__all__ = ["source_sizes", "tempered_weights", "repetition_rates", "poisson_cdf", "replicate_to_weights"]

SEED = 20240611
ALPHA = 0.5        # target share of a source ~ (its share of the corpus) ** ALPHA
EPOCHS = 1.0       # budget: this many times the corpus
PART_MEAN = 64.0   # larger means are drawn as sums of parts with at most this mean
_TAIL = 64         # a table reaches mean + 10 sd + this many counts
_NO_SOURCE = "\x00"


def _source(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(_NO_SOURCE))


def source_sizes(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """source, n_docs, size (code points of text)."""
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return (docs.select(_source(source_col).alias("mix_source"), size.cast("long").alias("size"))
            .groupBy("mix_source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("size")))


def tempered_weights(sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(mix_source, weight): share of the corpus to the power ``alpha``."""
    return sizes.select("mix_source", F.pow(F.col("size").cast("double"), F.lit(alpha)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """mix_source, rate: mean number of copies of each of its documents.
    Weights need not add up to one; sources without a row have weight 0."""
    both = sizes.join(weights, "mix_source", "left").na.fill({"weight": 0.0})
    total = both.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return both.crossJoin(F.broadcast(total)).select(  # one row: the totals
        "mix_source", "size",
        F.when((F.col("size") > 0) & (F.col("all_weight") > 0),
               F.col("weight") / F.col("all_weight") * F.lit(epochs) * F.col("all_size") / F.col("size"))
        .otherwise(0.0).alias("rate"))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., for a mean of at most PART_MEAN; the
    rest beyond the last entry is under 1e-12."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + F.lit(_TAIL)).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def replicate_to_weights(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                         epochs: float = EPOCHS, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Copies of ``docs``, globally shuffled: all columns, plus ``copy`` (0, 1,
    ...) and ``shuffle_key``.  ``weights`` (mix_source, weight) are the target
    shares; without them shares are tempered by ``alpha``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mixing")
    sizes = source_sizes(docs, source_col)
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    rates = repetition_rates(sizes, weights if weights is not None else tempered_weights(sizes, alpha), epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")
    (rates.select("mix_source", parts.alias("mix_parts"), poisson_cdf(F.col("rate") / parts).alias("mix_cdf"))
     .write.parquet(f"{path}/cdf"))
    cdf = spark.read.parquet(f"{path}/cdf")
    # without a doc_id the text tells documents apart
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")),
                        lambda i: uniform01(F.concat(key, F.lit("|"), i.cast("string")), f"#{seed}"))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    copies = (docs.select(F.struct("*").alias("row"), _source(source_col).alias("mix_source"))
              .join(cdf, "mix_source")
              .select("row", drawn.alias("n")).where("n > 0")
              .select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")))
    shuffle_key = F.md5(F.concat(key, F.lit("|"), F.col("copy").cast("string"), F.lit(f"#{seed}s")))
    dealt = copies.withColumn("shuffle_key", shuffle_key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    keep = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "copy", "shuffle_key")
