"""Evaluation, trust updates, weight consolidation and the default model against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import decisions as D
from tickerloom.operators import adaptive as A, direction_model as M, evaluation as E, predict as P
from tickerloom.settings import ModelSettings, TrainingSettings

SCHEMA = "row_id long, trade_date date, ticker string, label int, prob double, variance double, split string"


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 600
    # one date and one ticker hold a third of the rows
    day = np.where(rng.random(n) < 0.34, 40, rng.integers(0, 90, n))
    prob = np.round(rng.random(n), 2)
    prob[:3] = (0.0, 0.5, 1.0)
    return pd.DataFrame({
        "row_id": np.arange(n), "trade_date": [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in day],
        "ticker": np.where(rng.random(n) < 0.34, "HOT", rng.choice(list("ABC"), n)),
        "label": rng.integers(0, 2, n), "prob": prob, "variance": np.round(rng.gamma(2.0, 0.01, n), 4),
        "split": rng.choice(["test", "val"], n, p=[0.9, 0.1]),
    })


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def judged_frame(frame):
    df = frame[frame.split == "test"].copy()
    df["abstained"] = df.variance > df.variance.mean() + 1.5 * df.variance.std()
    df["pred"] = ((df.prob >= 0.5) & ~df.abstained).astype(int)
    return df


def judged(rows):
    return E.judge(E.select_split(rows, "test"))


def f1(d, cls):
    tp = ((d.pred == cls) & (d.label == cls)).sum()
    fp = ((d.pred == cls) & (d.label != cls)).sum()
    fn = ((d.pred != cls) & (d.label == cls)).sum()
    p, r = tp / (tp + fp + 1e-9), tp / (tp + fn + 1e-9)
    return 2 * p * r / (p + r + 1e-9)


def test_overall(rows, judged_frame):
    r = E.overall(judged(rows)).collect()[0]
    active = judged_frame[~judged_frame.abstained]
    assert (r.n_total, r.n_active) == (len(judged_frame), len(active)) and r.n_active < r.n_total
    assert r.accuracy == pytest.approx((active.pred == active.label).mean())
    assert r.macro_f1 == pytest.approx((f1(active, 1) + f1(active, 0)) / 2)
    assert r.abstention_rate == pytest.approx(judged_frame.abstained.mean())


def test_empty_split_has_no_overall_row(rows):
    assert E.overall(E.judge(E.select_split(rows, "none"))).count() == 0


def test_identical_variances_abstain_from_nothing(spark):
    df = spark.createDataFrame([(i, dt.date(2024, 1, 1), "A", 1, 0.7, 0.02, "test") for i in range(4)], SCHEMA)
    assert E.judge(df).filter("abstained").count() == 0
    assert E.judge(df.limit(1)).filter("abstained").count() == 0


def test_per_ticker(rows, judged_frame):
    got = {r.ticker: r for r in E.per_ticker(judged(rows)).collect()}
    for ticker, d in judged_frame.groupby("ticker"):
        a = d[~d.abstained]
        assert got[ticker].n_active == len(a)
        assert got[ticker].accuracy == pytest.approx((a.pred == a.label).mean())
        assert got[ticker].abstention_rate == pytest.approx(d.abstained.mean())


def test_tiers(rows, judged_frame):
    d = judged_frame
    for r in E.confidence_tiers(E.select_split(rows, "test")).collect():
        inside = d[d.variance <= d.variance.mean() + r.sigma * d.variance.std()]
        assert r.n == len(inside)
        assert r.accuracy == pytest.approx(((inside.prob >= 0.5).astype(int) == inside.label).mean())


def test_calibration_matches_comparisons_on_edges(rows, judged_frame):
    a = judged_frame[~judged_frame.abstained]
    edges = np.linspace(0, 1, 11)
    total, table = 0.0, []
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (a.prob >= lo) & (a.prob < hi)
        if m.sum():
            total += m.sum() / len(a) * abs(a.label[m].mean() - a.prob[m].mean())
            table.append((round((lo + hi) / 2, 2), int(m.sum())))
    assert E.calibration_error(judged(rows)).first().ece == pytest.approx(total)
    got = E.reliability(judged(rows)).orderBy("bin_mid").collect()
    assert [(r.bin_mid, r["count"]) for r in got] == table


@pytest.mark.parametrize("days, bits", [(30, 2), (30, 20), (7, 4)])
def test_rolling_accuracy_ends_at_each_row(rows, judged_frame, days, bits):
    a = judged_frame[~judged_frame.abstained].sort_values(["trade_date", "row_id"]).copy()
    a["correct"] = (a.pred == a.label).astype(float)
    a.index = pd.to_datetime(a.trade_date)
    want = a["correct"].rolling(f"{days}D").mean().to_numpy()
    got = E.rolling_accuracy(judged(rows), days, "row_id", bits).orderBy("trade_date", "row_id").toPandas()
    np.testing.assert_allclose(got.accuracy.to_numpy(), want)
    s = E.rolling_summary(E.rolling_accuracy(judged(rows), days)).collect()[0]
    assert (s.rolling_min, s.rolling_max, s.rolling_mean) == pytest.approx((want.min(), want.max(), want.mean()))


def test_a_row_exactly_thirty_days_old_is_outside(spark):
    days = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    df = spark.createDataFrame(
        [(i, d, "A", i, 0.9, 0.01, "test") for i, d in enumerate(days)], SCHEMA)
    got = [r.accuracy for r in E.rolling_accuracy(E.judge(df), 30).orderBy("trade_date").collect()]
    assert got == [0.0, 1.0]


def test_report_has_every_section(rows):
    tables = E.report_tables(rows, "val")
    assert set(tables) == {"overall", "confidence_tiers", "per_ticker", "rolling_series", "rolling_summary",
                           "reliability", "calibration", "confusion"}
    assert all(t.count() > 0 for t in tables.values())


def test_trust_update_folds_sources_in_order(spark):
    log = [("Reuters A", True)] * 3 + [("reuters b", False)] * 4 + [(None, True), ("blog", False), ("x", None)]
    df = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(log)], "row_id long, source string, correct boolean")
    weights = (("reuters", 1.0), ("default", 0.5))
    got = {r.key: r.new_weight for r in A.update_weights(A.source_accuracy(df, "row_id"), weights).collect()}
    w = round(max(0.1, min(1.0, 0.95 * 1.0 + 0.05 * 1.0)), 4)
    w = round(max(0.1, min(1.0, 0.95 * w + 0.05 * 0.0)), 4)
    d = round(0.95 * 0.5 + 0.05 * 1.0, 4)
    d = round(0.95 * d + 0.05 * 0.0, 4)
    assert got == pytest.approx({"reuters": w, "default": d})
    table = A.next_weights(spark, A.update_weights(A.source_accuracy(df, "row_id"), weights), weights).collect()
    assert [(r.key, r.weight) for r in table] == [("reuters", pytest.approx(w)), ("default", pytest.approx(d))]


def test_weights_stay_within_bounds(spark):
    df = spark.createDataFrame([(0, "reuters", False)], "row_id long, source string, correct boolean")
    got = A.update_weights(A.source_accuracy(df, "row_id"), (("reuters", 0.1),)).first()
    assert got.new_weight == 0.1


def test_monte_carlo_is_mean_and_unbiased_variance(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    out = P.monte_carlo(df, ["x"], lambda i: F.col("x") / (i + 1.0), 5).collect()
    for r in out:
        draws = r.x / (np.arange(1, 6) + 1.0)
        assert r.prob == pytest.approx(draws.mean()) and r.variance == pytest.approx(draws.var(ddof=1))


@pytest.mark.parametrize("prob, var, out", [
    (0.7, 0.4, "ABSTAIN"), (0.5, 0.01, "LOW-CONFIDENCE UP"), (0.45, 0.01, "LOW-CONFIDENCE DOWN"), (0.9, 0.01, "UP"),
    (0.1, 0.0, "DOWN"),
])
def test_reported_output(spark, prob, var, out):
    df = P.decide(spark.createDataFrame([(prob, var)], "prob double, variance double"))
    assert df.select(D.reported_output("direction", "confidence")).first()[0] == out


def test_match_flag_is_null_without_expectation(spark):
    df = spark.createDataFrame([("UP", ""), ("UP", "UP"), ("UP", "DOWN")], "a string, e string")
    assert [r[0] for r in df.select(D.matches_expected("a", "e")).collect()] == [None, True, False]


def test_epoch_choice_prefers_the_earliest(spark):
    df = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.7, 0.4), (3, 0.7, 0.4)], "epoch int, val_acc double, train_loss double")
    assert E.best_epoch(df).first().epoch == 2 and E.lowest_loss_epoch(df).first().epoch == 2


def test_distillation_loss(spark):
    df = spark.createDataFrame([(2.0, -1.0, 0.5, 0.6, 0.3, 0.1, 2)], "a double, b double, c double, p double, q double, r double, y int")
    got = df.select(D.distillation_loss([F.col("a"), F.col("b"), F.col("c")], [F.col("p"), F.col("q"), F.col("r")], "y")).first()[0]
    z, s = np.array([2.0, -1.0, 0.5]), np.array([0.6, 0.3, 0.1])
    ls = lambda v: v - np.log(np.exp(v).sum())
    want = 0.7 * (s * (np.log(s) - ls(z / 4))).sum() - 0.3 * ls(z)[2]
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 4))
    y = (x @ np.array([1.5, -2.0, 0.0, 0.5]) + rng.normal(0, 0.3, 500) > 0).astype(float)
    rows = [(x[i].tolist(), float(y[i]), "train" if i < 400 else "test", "A", dt.date(2020, 1, 1) + dt.timedelta(days=i))
            for i in range(500)]
    return spark.createDataFrame(rows, "features array<double>, label double, split string, ticker string, trade_date date")


def test_model_learns_and_is_repeatable(samples):
    model = M.fit(samples, TrainingSettings(epochs=50))
    scored = M.mc_scores(samples.filter("split = 'test'"), model, ModelSettings(mc_dropout_passes=20), seed=3)
    a = scored.select("prob", "variance").collect()
    assert a == M.mc_scores(samples.filter("split = 'test'"), model, ModelSettings(mc_dropout_passes=20), seed=3).select(
        "prob", "variance").collect()
    assert E.overall(E.judge(scored)).first().accuracy > 0.85
    assert all(0 <= r.prob <= 1 and r.variance >= 0 for r in a)


def test_fisher_and_nudge_match_numpy(samples):
    model = M.DirectionModel((0.2, -0.1, 0.0, 0.3), 0.1)
    pdf = samples.toPandas()
    x = np.hstack([np.stack(pdf.features.to_numpy()), np.ones((len(pdf), 1))])
    theta = np.array([0.2, -0.1, 0.0, 0.3, 0.1])
    g = (1 / (1 + np.exp(-x @ theta)) - pdf.label.to_numpy())[:, None] * x
    fisher = M.fisher(samples, model)
    batch = np.array([r.b for r in samples.select(F.pmod(F.xxhash64("features", "label"), F.lit(50)).alias("b")).collect()])
    per_batch = np.stack([g[batch == b].mean(axis=0) for b in np.unique(batch)])
    np.testing.assert_allclose(fisher, (per_batch**2).sum(axis=0) / 50)
    nudged = M.ewc_nudge(samples, model, fisher, strength=10.0, rate=0.1, steps=1)
    grad = g.mean(axis=0)
    grad *= min(1.0, 0.5 / np.linalg.norm(grad))
    np.testing.assert_allclose([*nudged.weights, nudged.bias], theta - 0.1 * grad)


def test_anchor_pulls_back_from_the_second_step_on(samples):
    model = M.DirectionModel((0.2, -0.1, 0.0, 0.3), 0.1)
    fisher = np.full(5, 0.05)
    moved = {
        (steps, strength): np.array(M.ewc_nudge(samples, model, fisher, strength, 0.1, steps).weights) - np.array(model.weights)
        for steps in (1, 3) for strength in (0.0, 40.0)
    }
    np.testing.assert_allclose(moved[1, 0.0], moved[1, 40.0])
    assert np.linalg.norm(moved[3, 40.0]) < 0.9 * np.linalg.norm(moved[3, 0.0])


def test_no_training_rows_is_an_error(samples):
    with pytest.raises(ValueError):
        M.fit(samples.filter("split = 'test'"))
