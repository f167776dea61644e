"""Keep-first de-duplication of articles.

``row_number() = 1`` is planned with a group limit below the exchange: every
map task forwards at most one row per key, so a key that covers a third of all
rows arrives at its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_key

MERGE_KEYS = ("url", "datetime", "ticker", "headline")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key combination in the given order (NULL keys group together)."""
    ranked = df.withColumn(
        "_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter(F.col("_nth") == 1).drop("_nth")


def with_row_hash(df: DataFrame) -> DataFrame:
    present = {c: c if c in df.columns else None for c in ("url", "headline")}
    return df.withColumn("row_hash", article_key(present["url"], present["headline"]))


def dedup_articles(df: DataFrame, order: Sequence[str], per: Sequence[str] = ("ticker",)) -> DataFrame:
    """First copy of every article, within each ticker.

    Articles are de-duplicated after the ticker filter, so the same article
    listed under two tickers stays in both: the ticker belongs to the key.
    """
    scope = [c for c in per if c in df.columns]
    return keep_first(with_row_hash(df), [*scope, "row_hash"], order)


def merge_masters(frames: Sequence[DataFrame], order: Sequence[str] = ("file_ord", "row_ord")) -> DataFrame:
    """Union of master tables, first copy per (url, datetime, ticker, headline).

    Copies agree on every sort key, so the stable sort of the input order only
    decides by (file, row) which copy is first.
    """
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return keep_first(merged, MERGE_KEYS, order)
