"""Eleven rolling price features over daily bars.

All windows use one (ticker, trade_date) specification.  Values that need only
raw columns are computed first, those that roll over a derived column second;
the two window levels share a single exchange and a single sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import (
    clip_low, log_pos, percent_rank_average, ratio, rolling_mean, rolling_std, series,
)
from ..settings import PRICE_FEATURES, FeatureSettings

EPS = 1e-9


def price_features(bars: DataFrame, opts: FeatureSettings = FeatureSettings()) -> DataFrame:
    """All feature columns plus the bar columns; warm-up rows hold NULLs.

    Non-finite intermediate values (log of zero, division by zero) are NULL.
    """
    by = series()
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    lagged = bars.withColumns({
        "_prev": F.lag("close").over(by),
        "_log_vol": log_pos(clip_low(volume, 1.0)),
    })
    prev = F.col("_prev")
    change = close - prev
    derived = lagged.withColumns({
        "log_ret": log_pos(ratio(close, prev)),
        "gap_open": log_pos(clip_low(ratio("open", prev), 1e-6)),
        "_gain": clip_low(change, 0.0),
        "_loss": clip_low(-change, 0.0),
        # greatest() skips the NULL previous close of the first bar, as wanted here
        "_range": F.greatest(high - low, F.abs(high - prev), F.abs(low - prev)),
    })
    ma_short, ma_mid, ma_long = (
        ratio(close, clip_low(rolling_mean(close, n, by), 1e-6)) for n in opts.ma_periods
    )
    strength = rolling_mean("_gain", opts.rsi_period, by) / (rolling_mean("_loss", opts.rsi_period, by) + EPS)
    bands = opts.bollinger_period
    rolled = derived.withColumns({
        "vol_norm": ratio(volume, clip_low(rolling_mean(volume, opts.volume_norm_window, by), 1.0)),
        "rsi_14": (F.lit(100.0) - F.lit(100.0) / (strength + 1.0)) / 100.0,
        "ma20_ratio": ma_short,
        "ma50_ratio": ma_mid,
        "ma200_ratio": ma_long,
        "bb_width": rolling_std(close, bands, by) * 2.0 / (rolling_mean(close, bands, by) + EPS),
        "atr": rolling_mean("_range", opts.atr_period, by),
        "vol_z": _zscore("_log_vol", opts, by),
        "log_ret_z": _zscore("log_ret", opts, by),
    })
    return rolled.withColumn("atr_14_norm", ratio("atr", clip_low(close, 1e-6))).select(
        "ticker", "trade_date", *PRICE_FEATURES, "atr", "close"
    )


def _zscore(name: str, opts: FeatureSettings, by):
    window, least = opts.zscore_window, opts.zscore_min_periods
    return (F.col(name) - rolling_mean(name, window, by, least)) / (rolling_std(name, window, by, least) + EPS)


def warm_rows(features: DataFrame) -> DataFrame:
    """Rows with every feature present."""
    return features.na.drop(subset=list(PRICE_FEATURES))


def with_atr_percentile(features: DataFrame) -> DataFrame:
    """Percentile of the normalised range over the ticker's whole history.

    Looks at the full series by design of the modelled pipeline, including
    days after the row.
    """
    return features.withColumn("atr_pct", percent_rank_average("atr_14_norm"))


def with_window_length(features: DataFrame, opts: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Look-back length: shorter in volatile regimes, truncated towards zero."""
    steps = (F.col("atr_pct") * opts.window_atr_scale).cast("int")
    return features.withColumn(
        "window", F.greatest(F.lit(opts.window_min), F.lit(opts.window_max) - steps)
    )


def from_date(bars_between, features_of, start, lookback_rows: int) -> DataFrame:
    """Features from ``start`` on without reading the whole history.

    ``bars_between(first, before)`` gives the bars of a range of days (None: open).  The look-back is counted in rows, so
    the earliest bar any ticker needs is found first (a top-k limited before its shuffle); that one date then bounds the
    second scan as a literal, which reaches the files.  Not valid for full-history percentiles.
    """
    newest_first = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    before = bars_between(None, start).select("ticker", "trade_date")
    needed = before.withColumn("_n", F.row_number().over(newest_first)).filter(F.col("_n") <= lookback_rows)
    earliest = needed.agg(F.min("trade_date")).first()[0] or start
    return features_of(bars_between(earliest, None)).filter(F.col("trade_date") >= F.lit(start))
