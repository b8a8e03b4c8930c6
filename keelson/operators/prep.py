"""Raw entity table -> model features (the feature-preparation job).

Every step is a column expression except the rare-category fold, which needs
value counts: a partial hash aggregate (one row per category) joined back on
the category.  The count side is one row per distinct value, landed first: it
is broadcast when its measured size is under the broadcast threshold and
sort-merge joined (with skew splitting) when it is not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import (
    allow_or_other, binary_target, contains_any, fill_unknown, first_match_class,
    presence_flag, replace_values,
)
from keelson.operators.metrics import value_counts
from keelson.session import landed

__all__ = ["PrepSpec", "rename_columns", "fold_rare", "feature_prep"]


# --- fixed values of the original feature job (kept verbatim, in order) ---
DEFAULT_RENAMES = {"Height (m)": "Height", "Weight (kg)": "Weight", "Marital Status": "Marital_Status"}
DEFAULT_IDENTITY_KEEP = ["Public", "Secret", "Unknown"]
DEFAULT_GENDER_KEEP = ["Male", "Female"]
DEFAULT_MARITAL_REPLACE = {"Widow": "Widowed"}
DEFAULT_MARITAL_KEEP = ["Single", "Married", "Widowed", "Engaged", "Unknown"]
DEFAULT_MAGIC_KEYWORDS = ["magic"]
DEFAULT_MUTANT_KEYWORDS = ["mutate", "mutant"]
DEFAULT_ORIGIN_CLASSES = [
    ("Human", ["human"]),
    ("Mutant", ["mutate", "mutant"]),
    ("Asgardian", ["asgardian"]),
    ("Alien", ["alien"]),
    ("Symbiote", ["symbiote"]),
    ("Robot", ["robot"]),
    ("Cosmic Being", ["cosmic being"]),
]
DEFAULT_TARGET_KEEP = ["Alive", "Dead"]
DEFAULT_MIN_COUNT = 50
# --- end of fixed values ---


@dataclass(frozen=True)
class PrepSpec:
    """Column names and rules of the feature job; defaults are the original's."""
    renames: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_RENAMES))
    id_col: str = "PageID"
    id_out: str = "Id"
    universe_col: str = "Universe"
    min_count: int = DEFAULT_MIN_COUNT
    teams_col: str = "Teams"
    origin_col: str = "Origin"
    identity_col: str = "Identity"
    identity_keep: Sequence[str] = tuple(DEFAULT_IDENTITY_KEEP)
    gender_col: str = "Gender"
    gender_keep: Sequence[str] = tuple(DEFAULT_GENDER_KEEP)
    marital_col: str = "Marital_Status"
    marital_replace: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_MARITAL_REPLACE))
    marital_keep: Sequence[str] = tuple(DEFAULT_MARITAL_KEEP)
    magic_col: str = "Magic"
    magic_keywords: Sequence[str] = tuple(DEFAULT_MAGIC_KEYWORDS)
    mutant_col: str = "Mutant"
    mutant_keywords: Sequence[str] = tuple(DEFAULT_MUTANT_KEYWORDS)
    origin_classes: Sequence[tuple[str, Sequence[str]]] = tuple(DEFAULT_ORIGIN_CLASSES)
    target_col: str = "Alive"
    target_keep: Sequence[str] = tuple(DEFAULT_TARGET_KEEP)
    num_features: Sequence[str] = ("Height", "Weight")
    cat_features: Sequence[str] = ("Universe", "Identity", "Gender", "Marital_Status",
                                   "Teams", "Origin", "Magic", "Mutant")
    unknown: str = "Unknown"
    other: str = "Other"


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def fold_rare(df: DataFrame, col: str, min_count: int, other: str = "Other") -> DataFrame:
    """Replace categories seen fewer than ``min_count`` times by ``other``.

    Counts are over *all* rows of ``df``.  The counts are landed and read back,
    so their measured size picks the join: a broadcast moves no row of ``df``,
    and beyond the threshold a sort-merge join splits a hot category."""
    tmp = f"__n_{col}"
    counts = landed(value_counts(df.select(col), col, tmp), "category_counts")
    joined = df.join(counts, on=col, how="left")
    return joined.withColumn(
        col, F.when(F.col(tmp) < F.lit(min_count), F.lit(other)).otherwise(F.col(col))
    ).drop(tmp).select(*df.columns)


def feature_prep(raw: DataFrame, spec: PrepSpec = PrepSpec()) -> DataFrame:
    """The composed preparation, steps in the original order:
    null-fill -> rare fold (counts over all rows) -> team flag -> origin fill ->
    identity filter -> gender allow-list -> marital replace + filter ->
    keyword flags (from the raw origin text) -> origin class -> target filter +
    encode -> projection, id as string."""
    s = spec
    df = rename_columns(raw, {k: v for k, v in s.renames.items() if v != s.marital_col})
    df = df.withColumn(s.universe_col, fill_unknown(s.universe_col, s.unknown))
    df = fold_rare(df, s.universe_col, s.min_count, s.other)
    df = df.withColumn(s.teams_col, presence_flag(s.teams_col))
    df = df.withColumn(s.origin_col, fill_unknown(s.origin_col, s.unknown))
    df = df.withColumn(s.identity_col, fill_unknown(s.identity_col, s.unknown))
    df = df.where(F.col(s.identity_col).isin(list(s.identity_keep)))
    df = df.withColumn(s.gender_col, allow_or_other(fill_unknown(s.gender_col, s.unknown),
                                                    s.gender_keep, s.other))
    df = rename_columns(df, {k: v for k, v in s.renames.items() if v == s.marital_col})
    df = df.withColumn(s.marital_col, replace_values(fill_unknown(s.marital_col, s.unknown),
                                                     s.marital_replace))
    df = df.where(F.col(s.marital_col).isin(list(s.marital_keep)))
    df = df.withColumns({
        s.magic_col: contains_any(s.origin_col, s.magic_keywords),
        s.mutant_col: contains_any(s.origin_col, s.mutant_keywords),
    })
    df = df.withColumn(s.origin_col, first_match_class(s.origin_col, s.origin_classes, s.other))
    df = df.where(F.col(s.target_col).isin(list(s.target_keep)))
    df = df.withColumn(s.target_col, binary_target(s.target_col, s.target_keep[0]))
    cols = list(s.num_features) + list(s.cat_features) + [s.target_col]
    return df.select(*[F.col(c) for c in cols], F.col(s.id_col).cast("string").alias(s.id_out))
