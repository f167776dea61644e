"""Fixed-length, front-padded feature sequences per labelled day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import series
from ..settings import PRICE_FEATURES, FeatureSettings
from .fusion import SENTIMENT


def _pack(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("float") for c in columns])


def _pad_front(rows: Column, length: int, width: int) -> Column:
    zero = F.array(*[F.lit(0.0).cast("float") for _ in range(width)])
    return F.concat(F.array_repeat(zero, F.lit(length) - F.size(rows)), rows)


def _last(rows: Column, count: Column) -> Column:
    return F.slice(rows, F.size(rows) - count + 1, count)


def training_sequences(fused: DataFrame, opts: FeatureSettings = FeatureSettings()) -> DataFrame:
    """One sample per labelled day past the first ``window_max`` rows.

    Input rows must be the warm rows with ``window``, ``label``,
    ``pos_in_series`` and ``n_rows``.  The sequence covers the ``window`` rows
    before the day and never the day itself; days without a label still feed
    the sequences of later days, so the label filter comes last.
    """
    length = opts.window_max
    frame = series().rowsBetween(-length, -1)
    both = F.collect_list(F.struct(_pack(PRICE_FEATURES).alias("p"), _pack(SENTIMENT).alias("s"))).over(frame)
    framed = fused.withColumn("_rows", both).filter(
        (F.col("pos_in_series") >= length) & (F.col("n_rows") > length) & F.col("label").isNotNull()
    )
    used = framed.withColumn("_rows", _last(F.col("_rows"), F.col("window")))
    return used.select(
        "ticker", "trade_date", "label", "window",
        _pad_front(F.col("_rows.p"), length, len(PRICE_FEATURES)).alias("price_seq"),
        _pad_front(F.col("_rows.s"), length, len(SENTIMENT)).alias("sentiment_seq"),
    )


def latest_sequence(features: DataFrame, opts: FeatureSettings = FeatureSettings()) -> DataFrame:
    """Inference sequence per ticker: the last ``window`` rows, newest day included.

    Only the newest ``window_max`` rows of a ticker take part, cut before the shuffle.
    """
    length = opts.window_max
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    recent = (
        features.filter(F.col("n_rows") > length)
        .withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= length)
    )
    packed = recent.groupBy("ticker").agg(
        F.max("trade_date").alias("trade_date"),
        F.max_by("window", "trade_date").alias("window"),
        F.array_sort(F.collect_list(F.struct("trade_date", _pack(PRICE_FEATURES).alias("p")))).alias("_rows"),
    )
    used = packed.withColumn("_rows", _last(F.col("_rows"), F.col("window")))
    return used.select(
        "ticker", "trade_date", "window",
        _pad_front(F.col("_rows.p"), length, len(PRICE_FEATURES)).alias("price_seq"),
    )


def repeated_sentiment(pos: Column, neg: Column, neu: Column, length: int) -> Column:
    """One headline's scores in every slot of every step."""
    vector = F.array(*[c.cast("float") for c in (pos, neg, neu) * 3])
    return F.array_repeat(vector, length)


def flat_features(samples: DataFrame, out: str = "features") -> DataFrame:
    """Both sequences flattened into one array<double> per sample."""
    flat = F.concat(F.flatten("price_seq"), F.flatten("sentiment_seq"))
    return samples.withColumn(out, flat.cast("array<double>"))


def latest_samples(samples: DataFrame, count: int = 1) -> DataFrame:
    """Newest ``count`` samples per ticker (limited before the shuffle)."""
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    return samples.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= count).drop("_age")
