"""Ordered lookups against small configured lists.

The lists come from configuration (tens of entries), so they become CASE
branches inside the generated code instead of a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def first_key_in(source: Column | str, keys: Iterable[str]) -> Column:
    """First configured key contained in the lower-cased source, else NULL."""
    low = F.lower(as_col(source))
    out: Column | None = None
    for key in keys:
        hit = F.instr(low, key) > 0
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return F.lit(None).cast("string") if out is None else out


def source_weight(source: Column | str, weights: Iterable[tuple[str, float]]) -> Column:
    """Weight of the first configured key contained in the source name."""
    weights = list(weights)
    fallback = F.lit(float(dict(weights).get("default", 0.5)))
    low = F.lower(as_col(source))
    out: Column | None = None
    for key, weight in weights:
        hit = F.instr(low, key) > 0
        out = F.when(hit, F.lit(float(weight))) if out is None else out.when(hit, F.lit(float(weight)))
    return fallback if out is None else out.otherwise(fallback)


def last_pattern_tag(headline: Column | str, patterns: Iterable[tuple[str, str]]) -> Column:
    """Tag of the last configured pattern found (case-insensitive), else empty."""
    text = F.coalesce(as_col(headline), F.lit(""))
    out: Column | None = None
    for pattern, tag in reversed(list(patterns)):
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, F.lit(tag)) if out is None else out.when(hit, F.lit(tag))
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def mentions_any(headline: Column | str, tickers: Iterable[str]) -> Column:
    """True when the upper-cased headline mentions one of the tickers."""
    high = F.upper(as_col(headline))
    hit = F.lit(False)
    for ticker in tickers:
        hit = hit | F.contains(high, F.lit(ticker.upper()))
    return F.coalesce(hit, F.lit(False))
