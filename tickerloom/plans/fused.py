"""Queries over sentiment, fusion, labels, sequences and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import fusion, sequences, splits
from ..settings import PRICE_FEATURES, sentiment_columns
from . import views as V
from .sql import r6, r6_all, split_case, with_views

SENT = sentiment_columns()
PARTS = ("pos", "neg", "neu")
KEYS = ("ticker", "trade_date")


def _r(*names):
    return [rounded(n).alias(n) for n in names]


def daily_sentiment(spark, sf_dir):
    return V.daily(spark, sf_dir).select(*KEYS, *_r(*PARTS), "hi_count", rounded("hi_weight").alias("hi_weight"))


def daily_sentiment_unique(spark, sf_dir):
    d = V.daily(spark, sf_dir, V.unique_news(spark, sf_dir))
    return d.select(*KEYS, *_r(*PARTS), "hi_count", rounded("hi_weight").alias("hi_weight"))


def sentiment_rolling(spark, sf_dir):
    return V.rolling(spark, sf_dir).select(*KEYS, *_r(*SENT))


def fuse_left_join(spark, sf_dir):
    """Warm price rows with the same day's sentiment, gaps left open."""
    return V.warm(spark, sf_dir).join(V.rolling(spark, sf_dir), list(KEYS), "left").select(*KEYS, *_r("close", *SENT))


def fuse_ffill(spark, sf_dir):
    out = fusion.attach_sentiment(V.warm(spark, sf_dir), V.rolling(spark, sf_dir))
    return out.select(*KEYS, *_r("close", *SENT))


def neutral_fallback(spark, sf_dir):
    """One ticker has no sentiment table and gets the constant neutral vector."""
    part = V.rolling(spark, sf_dir).filter(F.col("ticker") != "P")
    return fusion.attach_sentiment(V.warm(spark, sf_dir), part).select(*KEYS, *_r(*SENT))


def label_horizon(spark, sf_dir):
    return fusion.forward_label(V.warm(spark, sf_dir)).select(*KEYS, *_r("fwd_ret"), "label")


def min_history(spark, sf_dir):
    """Rows of long enough series, past the first window, with their position."""
    rows = fusion.enough_history(fusion.with_position(V.warm(spark, sf_dir)), V.FEATURES.window_max)
    return rows.filter(F.col("pos_in_series") >= V.FEATURES.window_max).select(
        *KEYS, F.col("pos_in_series").cast("long").alias("pos_in_series"), "n_rows"
    )


def sequences_train(spark, sf_dir):
    """Training sequences, one output row per step."""
    s = V.samples(spark, sf_dir)
    steps = s.select(*KEYS, "label", F.posexplode(F.arrays_zip("price_seq", "sentiment_seq")).alias("step", "x"))
    cells = [F.col("x.price_seq")[i].cast("double") for i in range(len(PRICE_FEATURES))]
    cells += [F.col("x.sentiment_seq")[i].cast("double") for i in range(len(SENT))]
    return steps.select(
        *KEYS, "label", F.col("step").cast("long").alias("step"),
        *[rounded(c, 4).alias(n) for c, n in zip(cells, (*PRICE_FEATURES, *SENT))],
    )


def sequence_latest(spark, sf_dir):
    s = sequences.latest_sequence(V.fused(spark, sf_dir), V.FEATURES)
    steps = s.select(*KEYS, F.col("window").cast("long").alias("window"), F.posexplode("price_seq").alias("step", "x"))
    return steps.select(
        *KEYS, "window", F.col("step").cast("long").alias("step"),
        *[rounded(F.col("x")[i].cast("double"), 4).alias(n) for i, n in enumerate(PRICE_FEATURES)],
    )


def fused_samples(spark, sf_dir):
    """The flagship: de-duplicated, gated news fused with price features into labelled samples."""
    f = V.fused(spark, sf_dir, V.unique_news(spark, sf_dir))
    length = V.FEATURES.window_max
    kept = fusion.enough_history(f, length).filter(
        (F.col("pos_in_series") >= length) & F.col("label").isNotNull()
    )
    return splits.assign_split(kept, V.SAMPLE_BOUNDS).select(
        *KEYS, "split", "label", F.col("window").cast("long").alias("window"), *_r(*PRICE_FEATURES, *SENT)
    )


def walk_forward_split(spark, sf_dir):
    return splits.split_sizes(splits.assign_split(V.labelled_days(spark, sf_dir), V.SAMPLE_BOUNDS))


def class_weight(spark, sf_dir):
    rows = splits.assign_split(V.labelled_days(spark, sf_dir), V.SAMPLE_BOUNDS)
    return splits.positive_weight(rows).select(*_r("n_pos", "n_neg", "pos_weight"))


def last_k_samples(spark, sf_dir):
    k = 5 * 5
    return sequences.latest_samples(V.labelled_days(spark, sf_dir), k).select(*KEYS, "label")


QUERIES = {
    f.__name__: f for f in (
        daily_sentiment, daily_sentiment_unique, sentiment_rolling, fuse_left_join, fuse_ffill, neutral_fallback,
        label_horizon, min_history, sequences_train, sequence_latest, fused_samples, walk_forward_split,
        class_weight, last_k_samples,
    )
}

_DAY = f"ticker, trade_date, {r6_all(PARTS)}, hi_count, {r6('hi_weight')} AS hi_weight"
_CELLS = ", ".join(
    f"{r6(f'CAST(CAST(coalesce(f.{c}, 0) AS FLOAT) AS DOUBLE)', 4)} AS {c}" for c in (*PRICE_FEATURES, *SENT)
)
_PRICE_CELLS = ", ".join(
    f"{r6(f'CAST(CAST(coalesce(f.{c}, 0) AS FLOAT) AS DOUBLE)', 4)} AS {c}" for c in PRICE_FEATURES
)

ORACLES = {
    "daily_sentiment": with_views("daily", f"SELECT {_DAY} FROM daily"),
    "daily_sentiment_unique": with_views("daily_unique", f"SELECT {_DAY} FROM daily_unique"),
    "sentiment_rolling": with_views("rolling", f"SELECT ticker, trade_date, {r6_all(SENT)} FROM rolling"),
    "fuse_left_join": with_views("warm rolling", f"""
        SELECT ticker, trade_date, {r6('w.close')} AS close, {r6_all(SENT)}
        FROM warm w LEFT JOIN rolling r USING (ticker, trade_date)"""),
    "fuse_ffill": with_views("attached", f"SELECT ticker, trade_date, {r6_all(('close', *SENT))} FROM attached"),
    "neutral_fallback": with_views("attached_part", f"SELECT ticker, trade_date, {r6_all(SENT)} FROM attached_part"),
    "label_horizon": with_views("warm", f"""
        SELECT ticker, trade_date, {r6('fwd')} AS fwd_ret,
               CASE WHEN fwd > 0.008 THEN 1.0::DOUBLE WHEN fwd < -0.008 THEN 0.0::DOUBLE END AS label
        FROM (SELECT *, lead(close, 3) OVER (PARTITION BY ticker ORDER BY trade_date) / close - 1 AS fwd FROM warm)"""),
    "min_history": with_views("warm", """
        SELECT * FROM (
          SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS pos_in_series,
                 count(*) OVER (PARTITION BY ticker) AS n_rows FROM warm)
        WHERE n_rows > 15 AND pos_in_series >= 15"""),
    "sequences_train": with_views("samples", f"""
        SELECT s.ticker, s.trade_date, s.label, t.step, {_CELLS}
        FROM samples s CROSS JOIN (SELECT unnest(range(15)) AS step) t
        LEFT JOIN fused f ON f.ticker = s.ticker AND f.pos_in_series = s.pos_in_series - 15 + t.step
                         AND t.step >= 15 - s."window" """),
    "sequence_latest": with_views("fused", f"""
        SELECT s.ticker, s.trade_date, s."window", t.step, {_PRICE_CELLS}
        FROM (SELECT * FROM fused WHERE n_rows > 15 AND pos_in_series = n_rows - 1) s
        CROSS JOIN (SELECT unnest(range(15)) AS step) t
        LEFT JOIN fused f ON f.ticker = s.ticker AND f.pos_in_series = s.pos_in_series - 14 + t.step
                         AND t.step >= 15 - s."window" """),
    "fused_samples": with_views("fused_unique", f"""
        SELECT * FROM (
          SELECT ticker, trade_date, {split_case('trade_date', V.SAMPLE_BOUNDS)} AS split, label, "window",
                 {r6_all((*PRICE_FEATURES, *SENT))}
          FROM fused_unique WHERE n_rows > 15 AND pos_in_series >= 15 AND label IS NOT NULL)
        WHERE split IS NOT NULL"""),
    "walk_forward_split": with_views("samples", f"""
        SELECT ticker, count(*) FILTER (s = 'train') AS n_train, count(*) FILTER (s = 'val') AS n_val,
               count(*) FILTER (s = 'test') AS n_test
        FROM (SELECT *, {split_case('trade_date', V.SAMPLE_BOUNDS)} AS s FROM samples)
        WHERE s IS NOT NULL GROUP BY 1"""),
    "class_weight": with_views("samples", f"""
        SELECT {r6('p')} AS n_pos, {r6('n - p')} AS n_neg, {r6('(n - p) / (p + 1e-9)')} AS pos_weight
        FROM (SELECT sum(label) AS p, count(label) AS n FROM samples
              WHERE {split_case('trade_date', V.SAMPLE_BOUNDS)} = 'train')"""),
    "last_k_samples": with_views("samples", """
        SELECT ticker, trade_date, label FROM samples
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) <= 25"""),
}
