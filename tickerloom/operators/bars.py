"""Daily bars from trade-level rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col


def daily_bars(trades: DataFrame, ticker: Column | str, day: Column | str, price: Column | str,
               sequence: Column | str, volume: Column) -> DataFrame:
    """Open/high/low/close/volume per (ticker, day).

    Every aggregate has a map-side partial form, so a dominant ticker is
    reduced to one row per day and map task before the shuffle.
    ``sequence`` orders the trades of a day and must be unique within it.
    """
    price, sequence = as_col(price), as_col(sequence)
    return trades.groupBy(as_col(ticker).alias("ticker"), as_col(day).alias("trade_date")).agg(
        F.min_by(price, sequence).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, sequence).alias("close"),
        volume.cast("double").alias("volume"),
    )
