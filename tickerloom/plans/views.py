"""Pipeline inputs and stages derived from the shared test tables.

Prices come from ``orders`` (a ticker per order status, one bar per day), news
from ``orders`` joined to ``documents``, evaluation rows and prediction logs
from ``events``, cases from ``conversations``.  ``sql.py`` states the same
views in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_key, detect_language
from ..functions.timing import gated_date, split_name
from ..operators import fusion, price_features as pf, scoring, sentiment, sequences
from ..operators.bars import daily_bars
from ..operators.dedup import keep_first
from ..settings import FeatureSettings

# Stand-in word lists: frequent words of the invented languages in ``documents``.
ENGLISH_WORDS = scoring.WordLists(positive=("to", "with", "by", "for", "and"), negative=("at", "from", "was", "of"))
OTHER_WORDS = scoring.WordLists(positive=("la", "und", "que", "le"), negative=("de", "der", "les"))
OTHER_LANGS = ("fr", "de", "es")

# Ordered trust keys with a prefix collision (src1 is contained in src10..src19).
TRUST = (("src1", 0.9), ("src12", 0.7), ("src3", 1.0), ("src0", 0.8), ("default", 0.5))

SAMPLE_BOUNDS = (
    ("train", "1995-01-01", "1998-12-31"), ("val", "1999-01-01", "1999-12-31"), ("test", "2000-01-01", "2001-12-31"),
)
EVENT_BOUNDS = (
    ("train", "2024-01-01", "2024-01-10"), ("val", "2024-01-11", "2024-01-18"), ("test", "2024-01-19", "2024-12-31"),
)
FEATURES = FeatureSettings()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame):
    """The table's size as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def bars(spark: SparkSession, sf_dir: str, first=None, before=None) -> DataFrame:
    """Daily bars, of the days from ``first`` on and ``before`` another; both bound the scan."""
    o = table(spark, sf_dir, "orders")
    for day, inside in ((first, lambda t, d: t >= d), (before, lambda t, d: t < d)):
        if day is not None:
            o = o.filter(inside(F.col("o_orderdate"), F.lit(f"{day} 00:00:00").cast(o.schema["o_orderdate"].dataType)))
    price = 100 + F.col("o_totalprice") / 50000.0
    return daily_bars(
        o, "o_orderstatus", F.to_date("o_orderdate"), price, "o_orderkey", F.sum(F.col("o_custkey") % 500 + 1)
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature rows, warm-up included."""
    return pf.price_features(bars(spark, sf_dir), FEATURES)


def warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.warm_rows(features(spark, sf_dir))


def documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per document: key, language class, source, scores.

    Texts are hashed and scored where they are read; only the results travel.
    """
    d = table(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 10 != 0, F.concat_ws("/", "source", F.col("n_chars").cast("string")))
    keyed = d.withColumn("url", url).withColumn("row_hash", article_key("url", "text"))
    scored = scoring.score_by_language(keyed, "text", "lang", ENGLISH_WORDS, OTHER_WORDS, OTHER_LANGS)
    return scored.select("doc_id", "lang", "source", "url", "row_hash", "pos", "neg", "neu")


def articles(spark: SparkSession, sf_dir: str, doc_columns: DataFrame) -> DataFrame:
    """Orders as published articles, each pointing at one document."""
    o, d = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    secs = (F.col("o_orderkey") * 7919 % 86400).cast("int")
    placed = o.select(
        F.col("o_orderkey").alias("row_ord"), F.col("o_orderstatus").alias("ticker"),
        F.timestamp_add("SECOND", secs, F.col("o_orderdate")).alias("pub_dt"),
        (F.col("o_orderkey") % row_count(d)).alias("doc_id"),
    )
    return placed.join(doc_columns, "doc_id")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = documents_scored(spark, sf_dir)
    return articles(spark, sf_dir, scored).withColumn("trade_date", gated_date("pub_dt"))


def unique_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(news(spark, sf_dir), ["ticker", "row_hash"], ["row_ord"])


def daily(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return sentiment.daily_sentiment(
        news(spark, sf_dir) if rows is None else rows, other_langs=OTHER_LANGS, weights=TRUST
    )


def rolling(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return sentiment.rolling_sentiment(daily(spark, sf_dir, rows))


def fused(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Warm price rows with sentiment, label, percentile, window length and position."""
    joined = fusion.attach_sentiment(warm(spark, sf_dir), rolling(spark, sf_dir, rows))
    labelled = fusion.forward_label(joined)
    ranked = pf.with_window_length(pf.with_atr_percentile(labelled), FEATURES)
    return fusion.with_position(ranked)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.training_sequences(fused(spark, sf_dir), FEATURES)


def labelled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and labels of the training samples, without their sequences."""
    return samples(spark, sf_dir).select("ticker", "trade_date", "label", "window")


def day_number(column: str = "trade_date"):
    return F.datediff(F.col(column), F.lit(dt.date(1970, 1, 1))).cast("long")


def scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with an arithmetic stand-in for the model's probability and variance."""
    n = day_number()
    return labelled_days(spark, sf_dir).withColumns({
        "prob": (n * 7919 % 10007) / 10007.0, "variance": (n * 31 % 97) / 140.0,
    })


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("row_id"), day.alias("trade_date"), F.col("event_type").alias("ticker"),
        F.when(F.col("value") >= 50, 1).otherwise(0).alias("label"),
        F.round((F.col("event_id") * 7919 % 10007) / 10007.0, 4).alias("prob"),
        F.round((F.col("event_id") * 104729 % 997) / 9970.0, 4).alias("variance"),
        split_name(day, EVENT_BOUNDS).alias("split"),
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("user_id") % 20
    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(n != 7, F.concat(F.lit("SRC"), n.cast("string"))).alias("source"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 3 != 0).alias("correct"),
    )


CASE_TICKERS = ("f", "O", "P", "X", "Z")
CASE_OUTPUTS = ("UP", "DOWN", "LOW-CONFIDENCE UP", "LOW-CONFIDENCE DOWN", "ABSTAIN", "")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as qualitative news cases; every key appears once."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")

    def choose(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))

    return c.select(
        key.alias("case_id"), choose(CASE_TICKERS, F.col("conv_id")).alias("ticker"),
        F.col("text").alias("news_input"), choose(CASE_OUTPUTS, key).alias("expected_model_output"),
    )


def case_language(df: DataFrame) -> DataFrame:
    """Detected language; text of unknown language goes to the English scorer."""
    found = detect_language(df, "news_input", "language")
    return found.withColumn("language", F.when(F.col("language") == "unknown", "en").otherwise(F.col("language")))
