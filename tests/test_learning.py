"""Fitted text models, student, tags, summaries, resumable training."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.text import devanagari_ratio
from tickerloom.operators import distill, scoring, second_language as SL, summary, tagging, textgen, training
from tickerloom.plans import stages
from tickerloom.settings import Settings
from tickerloom.sources.readers import Folder


@pytest.fixture(scope="module")
def texts(spark):
    other = [s for s in textgen.DEFAULT_SETS if s.lang != "en"]
    return textgen.generate(spark.range(1500).withColumnRenamed("id", "seed"), "seed", other).select("text", "label_name", "lang").cache()


def test_scorer_is_saved_and_used_for_the_second_language(spark, texts, tmp_path):
    model = SL.fit_scorer(texts, buckets=512, rounds=15)
    SL.save_scorer(model, str(tmp_path / "m"))
    again = SL.load_scorer(str(tmp_path / "m"))
    rows = spark.createDataFrame(
        [(1, "Lotus Retail mein Monday ko 4.4% ki tezi, Q2 results mazboot", "hinglish"), (2, "ग्रेनाइट रियल्टी को Q1 में नुकसान, शेयर सोमवार को 2.5% टूटे", "hi"),
         (3, "record profit", "en"), (4, None, "hi"), (5, "", "hinglish"), (6, "x", "unknown")], "id int, text string, lang string")
    one = {r.id: r for r in SL.model_scores(rows, "text", model).collect()}
    two = {r.id: r for r in SL.model_scores(rows, "text", again).collect()}
    assert one == two and all(abs(r.pos + r.neg + r.neu - 1) < 1e-9 for r in one.values())
    routed = {r.id: r for r in scoring.score_by_language(rows, "text", "lang", other_model=again).collect()}
    listed = {r.id: r for r in scoring.score_by_language(rows, "text", "lang").collect()}
    assert routed[1].pos == one[1].pos > 0.6 and routed[2].neg == one[2].neg > 0.6
    assert all((routed[i].pos, routed[i].neu) == (listed[i].pos, listed[i].neu) for i in (3, 6))
    assert set(routed[1].asDict()) == {"id", "text", "lang", "pos", "neg", "neu"}


def test_sentiment_stage_uses_the_fitted_scorer(spark, tmp_path):
    ws = stages.Workspace(spark, str(tmp_path / "ws"), Settings(tickers=("ITC",)))
    news = tmp_path / "ws" / "raw" / "news"
    news.mkdir(parents=True)
    (news / "n.csv").write_text("datetime,ticker,headline,source,url\n2024-01-05 10:00:00,ITC,इस सप्ताह लोटस रिटेल 5.8% गिरा Q3 नतीजे कमजोर,s,u\n" * 1, encoding="utf-8")
    assert stages.load_second_language(ws) is None
    before = stages.sentiment(ws).first()
    stages.second_language(ws, per_label=150)
    first = stages.load_second_language(ws)
    assert first is not None
    after = stages.sentiment(ws).collect()
    assert len(after) == 1 and before is not None


def test_detector_follows_its_counts(spark, texts):
    import math
    from collections import Counter

    langs = ("hi", "hinglish")
    table = SL.fit_detector(texts, langs)
    got = {r.gram: (r.hi, r.hinglish) for r in table.collect()}
    counts = {x: Counter() for x in langs}
    for r in texts.collect():
        low = r.text.lower()
        counts[r.lang].update(low[i:i + 3] for i in range(len(low) - 2))
    kinds = len(set(counts["hi"]) | set(counts["hinglish"]))
    for gram, values in got.items():
        for x, v in zip(langs, values, strict=True):
            assert v == pytest.approx(math.log((counts[x][gram] + 1) / (sum(counts[x].values()) + kinds + 1)))
    odd = spark.createDataFrame([(1, None), (2, " \n"), (3, "ab"), (4, "Lotus Retail mein tezi"), (5, "लोटसरिटेलमेंतेजी"), (6, "xy लोटस and more latin text")], "id long, text string")
    labels = {r.id: r.language for r in SL.model_language(odd, "id", "text", table, langs).collect()}
    assert labels == {1: "unknown", 2: "unknown", 3: "unknown", 4: "hinglish", 5: "hi", 6: "hinglish"}
    assert odd.select(devanagari_ratio("text").alias("r")).where("r > 0.85").count() == 1


def dense(rows, inputs):
    x = np.zeros((len(rows), inputs + 1))
    x[:, -1] = 1
    for i, (slots, shares, _, _) in enumerate(rows):
        x[i, slots] = shares
    return x, np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def test_student_gradient_losses_and_optimum(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(80):
        slots = sorted(rng.choice(5, rng.integers(0, 4), replace=False).tolist())
        rows.append((slots, rng.random(len(slots)).tolist(), rng.dirichlet([1, 1, 1]).tolist(), int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "slots array<int>, shares array<double>, soft array<double>, hard long").repartition(3)
    x, soft, hard = dense(rows, 5)

    def loss(w, t=2.0, alpha=0.6):
        return distill.row_losses(x @ w, soft, hard, t, alpha).mean()

    w = rng.normal(size=(6, 3))
    grad, n = distill._gradient(df, w, 2.0, 0.6)
    step = np.zeros_like(w)
    for i in np.ndindex(w.shape):
        d = np.zeros_like(w)
        d[i] = 1e-6
        step[i] = (loss(w + d) - loss(w - d)) / 2e-6
    assert n == 80 and np.allclose(grad, step, atol=1e-6)
    assert distill.losses(df, [w, 0 * w], 2.0, 0.6) == pytest.approx([loss(w), loss(0 * w)])
    fitted = distill.fit_student(df, 5, 3, 2.0, 0.6, rounds=40, least=1e-9)
    assert all(a >= b for a, b in zip(fitted.history, fitted.history[1:])) and fitted.history[-1] == pytest.approx(loss(fitted.weights))
    assert all(loss(fitted.weights + d) >= fitted.history[-1] - 1e-3 for d in rng.normal(0, 0.1, (50, 6, 3)))
    assert np.array_equal(distill.fit_student(df.limit(0), 5, 3).weights, np.zeros((6, 3)))
    probs = distill.student_scores(df, fitted).select("slots", "shares", "student").collect()
    z = {(tuple(r.slots), tuple(r.shares)): np.array(r.student) for r in probs}
    for (slots, shares, _, _), own in zip(rows, x, strict=True):
        e = np.exp(own @ fitted.weights)
        assert np.allclose(z[tuple(slots), tuple(shares)], e / e.sum())


def test_gram_features(spark):
    df = spark.createDataFrame([("AbAb",), ("",), (None,), ("a",)], "text string")
    got = {r.text: r for r in distill.gram_features(df, "text", 64).collect()}
    assert got["AbAb"].slots and sum(v * v for v in got["AbAb"].shares) == pytest.approx(1) and not got[""].slots and not got[None].slots and not got["a"].slots


def brute_tags(texts, names):
    out = []
    for t in texts:
        hits = {}
        for name, ord_, tag in names:
            if name and t is not None and name.lower() in t.lower():
                hits[name.lower()] = max(hits.get(name.lower(), (-1, "")), (ord_, tag))
        best = max(hits.values(), default=(-1, ""))
        out.append((t, best[1], len(hits)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [tagging.LIMIT, 60])
def test_tags_of_many_names(spark, limit):
    rng = np.random.default_rng(7)
    names = [("".join(rng.choice(list("abAB "), rng.integers(1, 5))), k, f"t{k}") for k in range(40)] + [("", 90, "never"), ("ab", 99, "last"), ("AB", 1000, "really last")]
    texts = ["".join(rng.choice(list("abcAB "), rng.integers(0, 30))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(t, "x", 1) for t in texts], "said string, tag string, ord int").drop("tag")
    listed = spark.createDataFrame(names, "name string, ord long, tag string")
    got = tagging.tag_names(df, "said", listed, limit)
    assert sorted(((r.said, r.tag, r.n_names) for r in got.collect()), key=str) == brute_tags(texts, names)
    assert {(r.tag, r.n_names) for r in tagging.tag_names(df, "said", listed.limit(0)).collect()} == {("", 0)}


def test_tagging_time_does_not_grow_with_the_names():
    text = "the quick brown fox " * 20_000

    def seconds(n):
        find = tagging._automaton([(f"name number {k} of many", k) for k in range(n)] + [("fox", n)])
        begin = time.perf_counter()
        assert {o for _, o in find.iter(text)} == {n}
        return time.perf_counter() - begin

    seconds(10)
    assert seconds(20_000) < 20 * seconds(20) + 0.2


def test_summary_against_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sentences = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "é"], rng.integers(1, 7))) + "." for _ in range(rng.integers(4, 12))]
        sets = [set(s[:-1].split()) for s in sentences]
        weight = {w: (len(sets) // sum(w in s for s in sets)).bit_length() for s in sets for w in s}
        link = np.array([[0 if i == j else sum(weight[w] for w in a & b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        rank = link @ (link @ np.ones(len(sets))) / [len(s) for s in sets]
        assert np.allclose(summary.sentence_ranks(sentences), rank)
        best = sorted(np.argsort(-rank, kind="stable")[:3])
        assert summary.extract(" ".join(sentences), 3) == " ".join(sentences[i] for i in best)


def test_summary_of_odd_texts_and_linear_time():
    assert summary.extract("", 3) == "" and summary.extract("...!?", 2) == "" and summary.extract(" One. Two? ", 3) == "One. Two?"
    assert summary.extract("--. ++. One two. Two one.", 2) == "One two. Two one."

    def seconds(n):
        text = "".join(f"common words and number {k % 997} here. " for k in range(n))
        begin = time.perf_counter()
        summary.extract(text, 3)
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(40_000) < 12 * seconds(5_000) + 0.3


def samples(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 2, 0]
    y = (x @ [1.0, -0.3, 4] + rng.normal(size=n) > 0).astype(int)
    split = ["train" if k % 4 else "val" for k in range(n)]
    rows = [(v.tolist(), int(b), s) for v, b, s in zip(x, y, split, strict=True)] + [([9.0, 9.0, 9.0], 1, "test")]
    return spark.createDataFrame(rows, "features array<double>, label int, split string").repartition(3).cache()


def test_resumed_training_ends_with_the_same_weights(spark, tmp_path):
    rows = samples(spark)
    straight = training.train_epochs(rows, str(tmp_path / "a"), 5)
    training.train_epochs(rows, str(tmp_path / "b"), 2)
    Folder(spark, str(tmp_path / "b")).write_text("epoch=00003/part-0.parquet", "left by a run that stopped")
    assert training.stored_epochs(spark, str(tmp_path / "b")) == [0, 1, 2]
    resumed = training.train_epochs(rows, str(tmp_path / "b"), 5)
    assert np.allclose(straight.weights, resumed.weights, atol=1e-12) and resumed.number == 5
    seen = training.history(spark, str(tmp_path / "b")).orderBy("epoch").collect()
    assert [r.epoch for r in seen] == [0, 1, 2, 3, 4, 5] and seen[-1].train_loss < seen[0].train_loss and seen[-1].val_acc > 0.8
    best = training.promote(spark, str(tmp_path / "b"))
    assert best == max(seen, key=lambda r: (r.val_acc, -r.epoch)).epoch
    assert json.loads(Folder(spark, str(tmp_path / "b")).read_text(training.POINTER))["epoch"] == best
    assert training.prune(spark, str(tmp_path / "b")) == sorted({best, 5}) == training.stored_epochs(spark, str(tmp_path / "b"))
    model = training.promoted(spark, str(tmp_path / "b")).model()
    right = [(np.dot(model.weights, r.features) + model.bias > 0) == (r.label == 1) for r in rows.where("split = 'val'").collect()]
    assert np.mean(right) == pytest.approx(max(r.val_acc for r in seen))


def test_training_without_rows(spark, tmp_path):
    rows = samples(spark).limit(0)
    last = training.train_epochs(rows, str(tmp_path / "none"), 2)
    assert last.number == 2 and np.allclose(last.weights, 0)
    only_train = training.train_epochs(samples(spark).where("split = 'train'"), str(tmp_path / "t"), 1)
    assert only_train.measures["val_rows"] == 0
