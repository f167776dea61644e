"""Daily source-weighted sentiment and its rolling means."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import source_weight
from ..functions.numeric import fill_forward, ratio, rolling_mean, series
from ..settings import SOURCE_WEIGHTS

PARTS = ("pos", "neg", "neu")
NEUTRAL = {"pos": 0.0, "neg": 0.0, "neu": 1.0}


def class_means(scored: DataFrame, day: str | Column = "trade_date", lang: str = "lang",
                other_langs: Sequence[str] = ("hi", "hinglish"),
                weights: Iterable[tuple[str, float]] = SOURCE_WEIGHTS) -> DataFrame:
    """Per (ticker, day): weighted score sums of the English and the second class.

    Sums and counts only, so the same aggregate serves batch and streaming and
    combines on the map side.  Days whose articles belong to neither class keep
    their row with zero counts.
    """
    w = source_weight("source", weights)
    is_en, is_hi = F.col(lang) == "en", F.col(lang).isin(*other_langs)
    sums: list[Column] = []
    for tag, mask in (("en", is_en), ("hi", is_hi)):
        sums.append(F.count_if(mask).alias(f"{tag}_count"))
        sums.append(F.sum(F.when(mask, w)).alias(f"{tag}_w"))
        sums += [F.sum(F.when(mask, w * F.col(p))).alias(f"{tag}_{p}") for p in PARTS]
    return scored.groupBy("ticker", F.col(day).alias("trade_date") if isinstance(day, str) else day).agg(*sums)


def blend_classes(sums: DataFrame, min_articles: int = 3) -> DataFrame:
    """Blend both classes; a sparse second class is ignored.

    Its weight is 0 below ``min_articles`` articles, then count / (2 * min),
    at most 1.  A class without articles contributes the neutral vector.
    """
    n = F.col("hi_count")
    hi_weight = F.when(n < min_articles, 0.0).otherwise(F.least(F.lit(1.0), n / F.lit(2.0 * min_articles)))
    out = sums.withColumn("hi_weight", hi_weight)
    blended = {}
    for p in PARTS:
        en = F.when(F.col("en_count") == 0, NEUTRAL[p]).otherwise(ratio(f"en_{p}", "en_w"))
        hi = F.when(F.col("hi_count") == 0, NEUTRAL[p]).otherwise(ratio(f"hi_{p}", "hi_w"))
        blended[p] = (1.0 - F.col("hi_weight")) * en + F.col("hi_weight") * hi
    return out.withColumns(blended).select("ticker", "trade_date", *PARTS, "hi_count", "hi_weight")


def daily_sentiment(scored: DataFrame, min_articles: int = 3, **options) -> DataFrame:
    return blend_classes(class_means(scored, **options), min_articles)


def rolling_sentiment(daily: DataFrame, windows: Sequence[int] = (1, 3, 7), fill_limit: int = 5) -> DataFrame:
    """Means over the last n days that have news (rows, not calendar days)."""
    by = series()
    filled = daily.withColumns({p: fill_forward(p, fill_limit, by) for p in PARTS})
    return filled.select(
        "ticker", "trade_date",
        *[rolling_mean(p, n, by, min_periods=1).alias(f"{p}_{n}d") for n in windows for p in PARTS],
    )
