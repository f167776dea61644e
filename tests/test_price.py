"""Price features against a straightforward pandas computation on awkward series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import fusion, price_features as pf, sequences
from tickerloom.settings import PRICE_FEATURES, FeatureSettings

OPTS = FeatureSettings()


def make_bars(seed, n, ticker, skip=()):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.005, n))
    high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    volume = rng.integers(0, 5000, n).astype(float)
    volume[n // 3] = 0.0
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n + len(skip)) if i not in skip][:n]
    return pd.DataFrame({"ticker": ticker, "trade_date": days, "open": open_, "high": high, "low": low,
                         "close": close, "volume": volume})


def expected(b):
    c, v = b.close, b.volume
    out = pd.DataFrame({"trade_date": b.trade_date})
    prev = c.shift(1)
    out["log_ret"] = np.log(c / prev)
    out["vol_norm"] = v / v.rolling(20).mean().clip(lower=1)
    out["gap_open"] = np.log((b.open / prev).clip(lower=1e-6))
    d = c.diff()
    rs = d.clip(lower=0).rolling(14).mean() / ((-d.clip(upper=0)).rolling(14).mean() + 1e-9)
    out["rsi_14"] = (100 - 100 / (1 + rs)) / 100
    for name, n in zip(("ma20_ratio", "ma50_ratio", "ma200_ratio"), (10, 20, 50)):
        out[name] = c / c.rolling(n).mean().clip(lower=1e-6)
    out["bb_width"] = 2 * c.rolling(20).std() / (c.rolling(20).mean() + 1e-9)
    tr = pd.concat([b.high - b.low, (b.high - prev).abs(), (b.low - prev).abs()], axis=1).max(axis=1)
    out["atr_14_norm"] = tr.rolling(14).mean() / c.clip(lower=1e-6)

    def z(s):
        r = s.rolling(50, min_periods=30)
        return (s - r.mean()) / (r.std() + 1e-9)

    out["vol_z"], out["log_ret_z"] = z(np.log(v.clip(lower=1))), z(out["log_ret"])
    return out


@pytest.fixture(scope="module")
def frames():
    return {"A": make_bars(1, 140, "A", skip=(5, 6, 40)), "B": make_bars(2, 29, "B"), "C": make_bars(3, 66, "C")}


@pytest.fixture(scope="module")
def bars(spark, frames):
    return spark.createDataFrame(pd.concat(frames.values(), ignore_index=True))


def test_features_match_pandas(bars, frames):
    got = pf.price_features(bars, OPTS).toPandas()
    for ticker, frame in frames.items():
        mine = got[got.ticker == ticker].sort_values("trade_date").reset_index(drop=True)
        want = expected(frame)
        for col in PRICE_FEATURES:
            np.testing.assert_allclose(
                mine[col].astype(float).to_numpy(), want[col].to_numpy(), rtol=1e-9, atol=1e-12, err_msg=f"{ticker} {col}")


def test_warm_rows_drop_only_incomplete_rows(bars, frames):
    got = {r.ticker: r.n for r in pf.warm_rows(pf.price_features(bars, OPTS)).groupBy("ticker").agg(
        F.count("*").alias("n")).collect()}
    want = {t: int(expected(f).dropna().shape[0]) for t, f in frames.items()}
    assert got == {t: n for t, n in want.items() if n}


def test_zero_price_gives_null_not_infinity(spark):
    b = make_bars(4, 80, "Z")
    b.loc[70, "close"] = 0.0
    rows = pf.price_features(spark.createDataFrame(b), OPTS).collect()
    for r in rows:
        for c in PRICE_FEATURES:
            assert r[c] is None or math.isfinite(r[c])


def test_percentile_averages_ties(spark):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    rows = [("A", dt.date(2020, 1, 1 + i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, atr_14_norm double")
    got = [r.atr_pct for r in pf.with_atr_percentile(df).orderBy("trade_date").collect()]
    np.testing.assert_allclose(got, pd.Series(values).rank(pct=True).to_numpy())


def test_window_length_truncates(spark):
    df = spark.createDataFrame([(0.249,), (0.25,), (0.05,), (0.99,), (0.0,)], "atr_pct double")
    got = [r.window for r in pf.with_window_length(df, OPTS).collect()]
    assert got == [max(5, 15 - int(p * 20)) for p in (0.249, 0.25, 0.05, 0.99, 0.0)]


def test_recent_features_equal_full_history(bars):
    start = dt.date(2020, 4, 1)
    cols = ["ticker", "trade_date", *PRICE_FEATURES]
    full = pf.price_features(bars, OPTS).filter(F.col("trade_date") >= F.lit(start)).select(*cols)

    def between(first, before):
        keep = F.lit(True) if first is None else F.col("trade_date") >= F.lit(first)
        return bars.filter(keep if before is None else keep & (F.col("trade_date") < F.lit(before)))

    recent = pf.from_date(between, lambda b: pf.price_features(b, OPTS), start, OPTS.zscore_window + 1).select(*cols)
    a = full.toPandas().sort_values(["ticker", "trade_date"]).reset_index(drop=True)
    b = recent.toPandas().sort_values(["ticker", "trade_date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def series(spark, closes, ticker="A"):
    rows = [(ticker, dt.date(2021, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, trade_date date, close double")


def test_label_thresholds(spark):
    closes = [100.0, 100.0, 100.0, 100.8, 100.81, 99.1, 100.0]
    got = [r.label for r in fusion.forward_label(series(spark, closes), 3, 0.008).orderBy("trade_date").collect()]
    # 100 -> 100.8 is within floating-point reach of the threshold; compute like the rule does
    want = []
    for i, c in enumerate(closes):
        if i + 3 >= len(closes):
            want.append(None)
            continue
        r = closes[i + 3] / c - 1
        want.append(1.0 if r > 0.008 else 0.0 if r < -0.008 else None)
    assert got == want


def test_fill_limit_counts_price_rows(spark):
    prices = series(spark, [1.0] * 9)
    cols = ", ".join(f"{c} double" for c in fusion.SENTIMENT)
    one = spark.createDataFrame(
        [("A", dt.date(2021, 1, 2), *[0.5] * 9)], f"ticker string, trade_date date, {cols}")
    rows = fusion.attach_sentiment(prices, one).orderBy("trade_date").collect()
    got = [r.neu_1d for r in rows]
    # day 1 precedes any value; the value lasts its own row plus five; later gaps become 0, also for neu
    assert got == [0.0] + [0.5] * 6 + [0.0, 0.0]


def test_ticker_without_sentiment_is_neutral(spark):
    prices = series(spark, [1.0] * 3, "A").union(series(spark, [1.0] * 3, "B"))
    cols = ", ".join(f"{c} double" for c in fusion.SENTIMENT)
    only_a = spark.createDataFrame([("A", dt.date(2000, 1, 1), *[0.3] * 9)], f"ticker string, trade_date date, {cols}")
    rows = fusion.attach_sentiment(prices, only_a).collect()
    assert {(r.ticker, r.pos_1d, r.neu_7d) for r in rows} == {("A", 0.0, 0.0), ("B", 0.0, 1.0)}


def fused_frame(spark, n, windows, labels):
    rows = []
    for i in range(n):
        feats = [float(i * 100 + k) for k in range(len(PRICE_FEATURES))]
        sent = [float(-i * 100 - k) for k in range(9)]
        rows.append(("A", dt.date(2021, 1, 1) + dt.timedelta(days=i), labels[i], windows[i], i, n, *feats, *sent))
    cols = ", ".join(f"{c} double" for c in (*PRICE_FEATURES, *fusion.SENTIMENT))
    return spark.createDataFrame(
        rows, f"ticker string, trade_date date, label double, window int, pos_in_series int, n_rows long, {cols}")


def test_training_sequences_exclude_the_day_and_pad_in_front(spark):
    n = 20
    windows = [5 + i % 11 for i in range(n)]
    labels = [None if i == 17 else float(i % 2) for i in range(n)]
    got = sequences.training_sequences(fused_frame(spark, n, windows, labels), OPTS).orderBy("trade_date").collect()
    assert [r.trade_date.day - 1 for r in got] == [15, 16, 18, 19]  # the unlabelled day 17 is left out ...
    for r in got:
        i = r.trade_date.day - 1
        w = windows[i]
        steps = [s[0] for s in r.price_seq]
        assert steps == [0.0] * (15 - w) + [float(j * 100) for j in range(i - w, i)]  # ... but still feeds later days
        assert all(len(s) == len(PRICE_FEATURES) for s in r.price_seq)
        assert [s[1] for s in r.sentiment_seq] == [0.0] * (15 - w) + [float(-j * 100 - 1) for j in range(i - w, i)]


def test_short_series_gives_no_sample(spark):
    df = fused_frame(spark, 15, [5] * 15, [1.0] * 15)
    assert sequences.training_sequences(df, OPTS).count() == 0
    assert sequences.latest_sequence(df, OPTS).count() == 0


def test_latest_sequence_includes_the_last_day(spark):
    n = 18
    r = sequences.latest_sequence(fused_frame(spark, n, [7] * n, [None] * n), OPTS).collect()[0]
    assert [s[0] for s in r.price_seq] == [0.0] * 8 + [float(j * 100) for j in range(n - 7, n)]


def test_latest_samples_per_ticker(spark):
    df = series(spark, [1.0] * 30).union(series(spark, [2.0] * 3, "B"))
    got = {r.ticker: r.n for r in sequences.latest_samples(df, 25).groupBy("ticker").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 25, "B": 3}
