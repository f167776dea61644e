"""Joining price features with sentiment, labels, and the history gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fill_forward, ratio, series
from ..settings import sentiment_columns

SENTIMENT = sentiment_columns()


def attach_sentiment(prices: DataFrame, sentiment: DataFrame, columns: Sequence[str] = SENTIMENT) -> DataFrame:
    """Price rows with the sentiment of their date.

    Gaps carry the last value over at most five price rows, then 0.  Tickers
    with no sentiment at all get the constant neutral vector.

    The full join keeps sentiment of non-trading days just long enough to see
    which tickers have any; it is dropped before the rows are counted for the
    gap limit.  That costs one pass over the sentiment plan instead of two, and
    every window shares one exchange on the ticker.
    """
    right = sentiment.select("ticker", "trade_date", *columns, F.lit(True).alias("_scored"))
    joined = prices.withColumn("_priced", F.lit(True)).join(right, ["ticker", "trade_date"], "full")
    covered = F.max(F.coalesce("_scored", F.lit(False))).over(Window.partitionBy("ticker"))
    rows = joined.withColumn("_covered", covered).filter(F.col("_priced"))
    by = series()
    filled = {}
    for c in columns:
        carried = F.coalesce(fill_forward(c, 5, by), F.lit(0.0))
        neutral = F.lit(1.0 if c.startswith("neu") else 0.0)
        filled[c] = F.when(F.col("_covered"), carried).otherwise(neutral)
    return rows.withColumns(filled).drop("_covered", "_scored", "_priced")


def forward_label(df: DataFrame, horizon: int = 3, threshold: float = 0.008) -> DataFrame:
    """1 / 0 for a forward return beyond +-threshold, NULL inside the band or at the end."""
    ahead = F.lead("close", horizon).over(series())
    out = df.withColumn("fwd_ret", ratio(ahead, "close") - 1.0)
    return out.withColumn(
        "label", F.when(F.col("fwd_ret") > threshold, 1.0).when(F.col("fwd_ret") < -threshold, 0.0)
    )


def with_position(df: DataFrame) -> DataFrame:
    """Zero-based row position and row count of each series."""
    return df.withColumns({
        "pos_in_series": F.row_number().over(series()) - 1,
        "n_rows": F.count(F.lit(1)).over(Window.partitionBy("ticker")),
    })


def enough_history(df: DataFrame, window_max: int = 15) -> DataFrame:
    """Series with more than ``window_max`` rows."""
    return df.filter(F.col("n_rows") > window_max)
