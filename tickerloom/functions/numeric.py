"""Null-safe arithmetic and row-window helpers.

pandas keeps NaN through ``clip`` and only emits a rolling value once the
window holds enough observations.  Spark's ``greatest`` skips NULL and its
frames are happy with partial windows, so both rules are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "ticker", "trade_date"


def series(key: str = KEY, order: str = ORDER) -> WindowSpec:
    """One time series per key.

    Every table this is applied to holds at most one row per (key, day), so a
    window partition is bounded by the number of calendar days in the history,
    however the raw rows are spread over the keys.
    """
    return Window.partitionBy(key).orderBy(order)


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(as_col(num), as_col(den))


def clip_low(x: Column | str, floor: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def log_pos(x: Column) -> Column:
    """Natural log; NULL where the log would not be finite."""
    return F.when(x > 0, F.ln(x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0."""
    r = F.round(as_col(x), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def trailing(over: WindowSpec, rows: int) -> WindowSpec:
    return over.rowsBetween(-(rows - 1), 0)


def rolling(fn, x: Column | str, rows: int, over: WindowSpec, min_periods: int | None = None) -> Column:
    """``fn`` over the last ``rows`` rows once enough values are present."""
    x = as_col(x)
    frame = trailing(over, rows)
    enough = F.count(x).over(frame) >= F.lit(rows if min_periods is None else min_periods)
    return F.when(enough, fn(x).over(frame))


def rolling_mean(x, rows, over, min_periods=None) -> Column:
    return rolling(F.avg, x, rows, over, min_periods)


def rolling_std(x, rows, over, min_periods=None) -> Column:
    return rolling(F.stddev_samp, x, rows, over, min_periods)


def fill_forward(x: Column | str, limit: int, over: WindowSpec) -> Column:
    """Last known value among this row and the ``limit`` rows before it."""
    return F.last(as_col(x), ignorenulls=True).over(over.rowsBetween(-limit, 0))


def percent_rank_average(x: Column | str, key: str = KEY) -> Column:
    """Rank / count with ties sharing their average rank (values must be non-null)."""
    name = x if isinstance(x, str) else None
    x = as_col(x)
    by_value = Window.partitionBy(key).orderBy(x)
    ties = Window.partitionBy(key, name or x)
    total = F.count(x).over(Window.partitionBy(key))
    return (F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / total
