"""Partition-independent pseudo-randomness from md5 of a key.

``rand()`` / ``randomSplit`` depend on partitioning and task order, so a
recomputed partition (lost executor) or a different cluster size would change
results.  Everything here is a pure function of (key, seed), and the same
formulas run unchanged in other SQL engines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.columns import as_col

__all__ = ["hash_u32", "hash_bucket", "uniform01", "uniform_open01", "std_normal"]

_U32 = 4294967296.0


def hash_u32(key: str | Column, salt: str) -> Column:
    """First 32 bits of md5(cast(key as string) || salt) as a non-negative bigint."""
    digest = F.md5(F.concat(as_col(key).cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: str | Column, seed: int, buckets: int) -> Column:
    return hash_u32(key, f"#{seed}") % F.lit(buckets)


def uniform01(key: str | Column, salt: str) -> Column:
    """Uniform on [0, 1)."""
    return hash_u32(key, salt) / F.lit(_U32)


def uniform_open01(key: str | Column, salt: str) -> Column:
    """Uniform on (0, 1) -- safe inside ``ln``."""
    return (hash_u32(key, salt) + F.lit(1)) / F.lit(_U32 + 1.0)


def std_normal(key: str | Column, seed: int) -> Column:
    """Standard normal by Box-Muller from two md5 uniforms."""
    u1 = uniform_open01(key, f"#{seed}a")
    u2 = uniform01(key, f"#{seed}b")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
