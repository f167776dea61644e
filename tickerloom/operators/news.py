"""From raw article rows to gated, de-duplicated news."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import gated_date, parse_market
from .dedup import dedup_articles
from .normalize import filter_tickers, with_defaults


def published_column(columns: Sequence[str]) -> Column:
    """Publication time text: ``datetime``, else ``date`` and ``time``, else ``date``."""
    if "datetime" in columns:
        return F.col("datetime")
    if "date" in columns and "time" in columns:
        return F.concat_ws(" ", F.coalesce("date", F.lit("nan")), F.coalesce("time", F.lit("nan")))
    if "date" in columns:
        return F.col("date")
    raise ValueError("news needs a 'datetime' or a 'date' column")


def prepare_news(raw: DataFrame, tickers: Sequence[str] | None, order: Sequence[str]) -> DataFrame:
    """Ticker filter, first copies, publication time, market-close gate, default columns.

    An existing trade_date is replaced.  Rows whose time cannot be read are dropped.
    """
    rows = dedup_articles(filter_tickers(raw, tickers), order)
    timed = rows.withColumn("pub_dt", parse_market(published_column(rows.columns)))
    gated = timed.withColumn("trade_date", gated_date("pub_dt")).na.drop(subset=["trade_date"])
    return with_defaults(gated, {"lang": "unknown", "source": "unknown", "body": ""})
