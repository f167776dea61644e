"""Monte-Carlo aggregation, prediction export and the qualitative case run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D

PREDICTION_COLUMNS = (
    "ticker", "date", "direction", "actual_direction", "prediction_result", "prob_up",
    "variance", "direction_strength", "stability", "confidence", "n_samples",
)


def monte_carlo(df: DataFrame, keys: Sequence[str], one_pass: Callable[[Column], Column], passes: int,
                mean: str = "prob", variance: str = "variance") -> DataFrame:
    """Mean and unbiased variance over stochastic passes per row.

    ``one_pass`` maps the pass number to a probability.  All passes of a row are columns of the same row, so
    nothing is shuffled and the two sums stay in generated code; ``keys`` are the columns to keep.
    """
    names = [f"_p{i}" for i in range(1, passes + 1)]
    draws = df.select(*keys, *[one_pass(F.lit(i)).alias(n) for i, n in enumerate(names, start=1)])
    total = reduce(add, [F.col(n) for n in names])
    spread = reduce(add, [(F.col(n) - F.col(mean)) * (F.col(n) - F.col(mean)) for n in names])
    return draws.withColumn(mean, total / float(passes)).select(*keys, mean, (spread / float(passes - 1)).alias(variance))


def decide(df: DataFrame, confidence_threshold: float = 0.65) -> DataFrame:
    """Direction, strength, stability and confidence, rounded for reporting."""
    abstain = D.fixed_abstain("variance", confidence_threshold)
    return df.withColumns({
        "direction": D.direction_or_abstain("prob", abstain),
        "direction_strength": F.round(D.direction_strength("prob"), 4),
        "stability": F.round(D.stability("variance"), 4),
        "confidence": F.round(D.confidence("prob", "variance"), 4),
        "prob_up": F.round("prob", 4),
    }).withColumn("variance", F.round("variance", 4))


def latest_predictions(scored_samples: DataFrame, confidence_threshold: float = 0.65) -> DataFrame:
    """One row per ticker: the newest labelled sample judged against its label.

    A single aggregate with a map-side part; the samples are read once.
    """
    newest = scored_samples.groupBy("ticker").agg(
        *[F.max_by(c, "trade_date").alias(c) for c in ("label", "prob", "variance")],
        F.count(F.lit(1)).alias("n_samples"), F.max("trade_date").alias("trade_date"),
    )
    return judge_latest(newest, confidence_threshold)


def judge_latest(newest: DataFrame, confidence_threshold: float = 0.65) -> DataFrame:
    """The prediction table from one scored row per ticker with its sample count."""
    actual = F.when(F.col("label") == 1, "UP").otherwise("DOWN")
    out = decide(newest, confidence_threshold).withColumn("actual_direction", actual).withColumn(
        "prediction_result", D.outcome("direction", "actual_direction")
    )
    return out.withColumn("date", F.date_format("trade_date", "yyyy-MM-dd")).select(*PREDICTION_COLUMNS)


def supported_cases(cases: DataFrame, price_tickers: DataFrame) -> DataFrame:
    """Cases whose ticker has price data."""
    return _upper(cases).join(_upper(price_tickers).select("ticker").distinct(), "ticker", "left_semi")


def dropped_tickers(cases: DataFrame, price_tickers: DataFrame) -> DataFrame:
    """Distinct tickers of the cases that have none."""
    return _upper(cases).select("ticker").distinct().join(
        _upper(price_tickers).select("ticker").distinct(), "ticker", "left_anti"
    )


def _upper(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", F.upper("ticker"))


def judge_cases(scored: DataFrame) -> DataFrame:
    """Polarity, reported output and match flag of scored cases.

    Needs pos, neg, neu, prob, variance and expected_model_output.
    """
    out = decide(scored)
    out = out.withColumns({
        "sentiment_polarity": D.polarity("pos", "neg"),
        "net_sentiment": F.round(F.col("pos") - F.col("neg"), 4),
        "actual_model_output": D.reported_output("direction", "confidence"),
    })
    return out.withColumn("match_expected", D.matches_expected("actual_model_output", "expected_model_output"))
