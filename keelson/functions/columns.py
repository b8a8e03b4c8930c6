"""Scalar expressions: null policy, category rules, casts, text builders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_col", "fill_unknown", "presence_flag", "allow_or_other", "replace_values",
    "contains_any", "first_match_class", "binary_target", "epoch_ms",
    "label_decode", "endpoint_slug", "flag_text", "approval_decision",
    "action_to_flag", "approval_link", "first_present_metric", "safe_double",
    "missing_fields", "as_utc_timestamp", "iso_stamp", "dated_name",
]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_unknown(c: str | Column, value: str = "Unknown") -> Column:
    """null -> ``value`` (pandas ``fillna``)."""
    return F.coalesce(as_col(c), F.lit(value))


def presence_flag(c: str | Column) -> Column:
    """1 when the value is present, else 0."""
    return as_col(c).isNotNull().cast("int")


def allow_or_other(c: str | Column, allowed: Sequence[str], other: str = "Other") -> Column:
    """Keep values in the allow-list, everything else (null included) -> other."""
    col = as_col(c)
    return F.when(col.isin(list(allowed)), col).otherwise(F.lit(other))


def replace_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Exact value replacement; values not in the mapping pass through."""
    col = as_col(c)
    out = None
    for src, dst in mapping.items():
        out = (F.when(col == F.lit(src), F.lit(dst)) if out is None
               else out.when(col == F.lit(src), F.lit(dst)))
    return col if out is None else out.otherwise(col)


def _lower_contains_any(col: Column, keywords: Iterable[str]) -> Column:
    low = F.lower(col)
    cond = None
    for k in keywords:
        hit = low.contains(F.lit(k.lower()))
        cond = hit if cond is None else (cond | hit)
    return cond if cond is not None else F.lit(False)


def contains_any(c: str | Column, keywords: Sequence[str]) -> Column:
    """1 if the case-folded text contains any keyword, else 0."""
    return _lower_contains_any(as_col(c), keywords).cast("int")


def first_match_class(c: str | Column, classes: Sequence[tuple[str, Sequence[str]]],
                      default: str = "Other") -> Column:
    """Priority classifier: the first class whose keywords occur wins."""
    col = as_col(c)
    out = None
    for label, keywords in classes:
        cond = _lower_contains_any(col, keywords)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def binary_target(c: str | Column, positive: str) -> Column:
    return (as_col(c) == F.lit(positive)).cast("int")


def as_utc_timestamp(c: str | Column, data_type: str | None = None) -> Column:
    """TIMESTAMP_NTZ wall-clock (defined as UTC) -> TIMESTAMP instant.

    The session time zone is pinned to UTC by ``keelson.session.prepare``;
    ``to_utc_timestamp`` makes the result independent of it anyway."""
    col = as_col(c)
    if data_type == "timestamp_ntz":
        return F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone())
    return col


def epoch_ms(c: str | Column) -> Column:
    """Epoch milliseconds truncated to whole seconds (seconds * 1000)."""
    return F.unix_seconds(as_col(c)) * F.lit(1000)


def label_decode(c: str | Column, positive: str = "alive", negative: str = "dead") -> Column:
    """Prediction code -> label; anything but 1 (null included) is negative."""
    col = as_col(c)
    return F.when(col == 1, F.lit(positive)).otherwise(F.lit(negative))


def endpoint_slug(name: str | Column, env: str | Column, max_len: int = 63) -> Column:
    """lower-case, '.' and '_' -> '-', append '-serving-<env>', cut to max_len."""
    env_col = F.lit(env) if isinstance(env, str) else env
    slug = F.concat(F.translate(F.lower(as_col(name)), "._", "--"), F.lit("-serving-"), env_col)
    return F.substring(slug, 1, max_len)


def flag_text(c: str | Column) -> Column:
    """Normalise a free-text flag: trim + upper case."""
    return F.upper(F.trim(as_col(c).cast("string")))


def approval_decision(flag: str | Column, pending: str = "PENDING") -> Column:
    """TRUE -> APPROVED, FALSE -> REJECTED, anything else (or no row) -> pending."""
    f = as_col(flag)
    return (F.when(f == "TRUE", F.lit("APPROVED"))
            .when(f == "FALSE", F.lit("REJECTED"))
            .otherwise(F.lit(pending)))


def action_to_flag(action: str | Column) -> Column:
    """APPROVE or absent -> 'TRUE', REJECT -> 'FALSE', else null (the caller rejects the row)."""
    a = F.coalesce(as_col(action), F.lit("APPROVE"))
    return F.when(a == "APPROVE", F.lit("TRUE")).when(a == "REJECT", F.lit("FALSE"))


def approval_link(base_url: str, params: Sequence[tuple[str, Column]]) -> Column:
    """``base?k1=v1&k2=v2`` with URL-encoded values."""
    parts: list[Column] = [F.lit(base_url)]
    for i, (k, v) in enumerate(params):
        parts.append(F.lit(("?" if i == 0 else "&") + k + "="))
        parts.append(F.url_encode(v.cast("string")))
    return F.concat(*parts)


def safe_double(c: str | Column) -> Column:
    """Untrusted text -> double or null (never raises under ANSI)."""
    return (as_col(c).cast("string")).try_cast("double")


def first_present_metric(metrics: str | Column, names: Sequence[str]) -> tuple[Column, Column]:
    """First metric *present* in the map decides; an uncastable value gives null.

    Returns ``(value, name)`` columns."""
    m = as_col(metrics)
    value = None
    name = None
    for n in names:
        present = F.map_contains_key(m, F.lit(n))
        v = (F.element_at(m, F.lit(n)).cast("string")).try_cast("double")
        value = F.when(present, v) if value is None else value.when(present, v)
        name = F.when(present, F.lit(n)) if name is None else name.when(present, F.lit(n))
    return value, name


def missing_fields(cols: Sequence[str]) -> Column:
    """Comma-separated names of required fields that are null; null when none."""
    names = [F.when(F.col(c).isNull(), F.lit(c)) for c in cols]
    joined = F.concat_ws(",", *names)
    return F.when(joined == "", F.lit(None).cast("string")).otherwise(joined)


def iso_stamp(c: str | Column) -> Column:
    """UTC ISO-8601 text stamp (microseconds), e.g. 2024-01-01T00:00:00.000000."""
    return F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def dated_name(prefix: str, c: str | Column) -> Column:
    """``<prefix>-YYYY-MM-DD`` run name from a timestamp."""
    return F.concat(F.lit(prefix + "-"), F.date_format(as_col(c), "yyyy-MM-dd"))
