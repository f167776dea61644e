"""Language ID, quality classifier, context mixing."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import context_mixing as cm
from tickerloom.llm import language_id as lid
from tickerloom.llm import quality_nbsvm as nb
from tickerloom.llm.common import fold

from . import conftest as data

SMALL = "/root/testdata/sf0.01"


def crc(i, m):
    return zlib.crc32(b"" if i is None else str(i).encode()) % m


def test_fold_is_crc32_of_the_text(odd):
    for r in odd.select("doc_id", fold("doc_id", 5).alias("f")).collect():
        assert r.f == crc(r.doc_id, 5)


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = lid.op7_language_id(spark, SMALL).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows) and held
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) >= 0.98
    sure = [r for r in held if r.accepted]
    assert all(0 <= r.score <= 1 for r in rows) and len(sure) > len(held) / 2
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in sure]) >= 0.99


def test_language_of_odd_rows(spark, odd, none):
    model = lid.fit(odd)
    rows = lid.identify(odd, model, fold("doc_id", 5) == 0).collect()
    assert len(rows) == len(data.ODD) and set(model.langs) == {"de", "en", "fr"} - ({"de"} if "de" not in model.langs else set())
    for r in rows:
        text = next(t for i, t, *_ in data.ODD if i == r.doc_id)
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text or "")) and (r.score > 0) == (r.lang_pred != "und")
    assert lid.fit(none) is None
    assert {r.lang_pred for r in lid.identify(odd, None, F.lit(False)).collect()} == {"und"}
    assert lid.identify(none, model, F.lit(False)).collect() == []


def test_language_scores_fold_embedding_and_softmax():
    texts = pa.array(["der die das und", "the of and", "", "le la les"])
    model = lid.LanguageModel(("a", "b"), np.random.default_rng(1).normal(size=(512, 2)), np.array([0.1, -0.1]), 2.0, 0.5)
    batch = pa.record_batch({"doc_id": pa.array([1, 2, 3, 4]), "text": texts, "held_out": [False] * 4, "letters": [True, True, False, True]})
    got = next(lid.predict_batches(iter([batch]), model)).to_pylist()
    for (bucket, n), r in zip(lid.bucket_sums(texts, 512), got, strict=True):
        if len(bucket):
            p = lid.softmax(((n / n.sum()) @ model.scores[bucket] + model.bias)[None] / 2.0)[0]
            assert abs(r["score"] - p.max()) < 1e-9 and r["lang_pred"] == model.langs[int(p.argmax())]


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = nb.op8_quality_nbsvm(spark, big).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 10_000 and len(held) > 500
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good = [r.predicted for r in held if truth[r.doc_id] == 1]
    bad = [r.predicted for r in held if truth[r.doc_id] == 0]
    assert np.mean(good) >= 0.995 and np.mean(bad) <= 0.05


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, 0), (6, 1, None), (8, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = nb.fit(odd, labels)
    rows = nb.score_quality(odd, model, fold("doc_id", 5) == 0).collect()
    assert len(rows) == len(data.ODD) and all(0 <= r.score <= 1 for r in rows)
    same = {round(r.score, 12) for r in rows if r.doc_id in (4, 5)}
    assert len(same) == 1
    assert all(r.score == pytest.approx(1.0, abs=1e-5) for r in nb.score_quality(odd, nb.fit(odd, labels.limit(0)), F.lit(False)).collect())
    assert nb.score_quality(none, model, F.lit(False)).collect() == []
    kept = nb.good_only(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    rows = [np.append(r, 12) for r in rows]
    sign = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    scale, cost = rng.normal(1, 0.3, 13), np.full(60, 0.1)
    w = nb.dual_descent(rows, scale, sign, cost, epochs=2000)
    loss = lambda v: 0.5 * v @ v + sum(c * max(0, 1 - s * (v[r] @ scale[r])) for r, s, c in zip(rows, sign, cost, strict=True))
    best = loss(w)
    assert all(loss(w + d) >= best - 1e-3 for d in rng.normal(0, 0.05, (300, 13)))


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]


def check_base(rows, texts):
    counts = collections.Counter(w for i, t in texts if crc(i, 7) != 2 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in texts:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want[i, crc(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), total, round(base, 4)] += 1
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)


def test_mixing_counts_and_gain(spark, docs, texts):
    rows = cm.score_texts(docs, fold("doc_id", 7) == 2).collect()
    check_base(rows, list(texts.items()))
    held = [r for r in rows if r.held_out]
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert held
    again = cm.score_texts(docs, fold("doc_id", 7) == 2).collect()
    assert {(r.doc_id, round(r.score, 6)) for r in rows} == {(r.doc_id, round(r.score, 6)) for r in again}


def test_mixing_of_odd_rows(spark, odd, none):
    rows = cm.score_texts(odd, fold("doc_id", 7) == 2).collect()
    check_base(rows, [(i, t) for i, t, *_ in data.ODD])
    assert cm.score_texts(none, F.lit(False)).collect() == []
    untrained = cm.score_texts(odd, F.lit(True)).collect()
    assert len(untrained) == len(data.ODD) and all(r.train_tokens == 0 and math.isfinite(r.score) for r in untrained)


def test_word_chances_are_a_distribution(spark):
    """Over all one-letter words with their end, by the path that scores: a chain of decisions never gives more than one."""
    rows = [(w, n) for w, n in (("ab", 3), ("abc", 1), ("b", 5), ("ba", 2), ("zz", 1))] + [(bytes([i]).decode("latin-1"), 0) for i in range(33, 127) if chr(i) != "b"]
    table = cm.sharded(spark.createDataFrame([*rows, ("qxj", 0)], "word string, c long"), 3, 4)
    gates = cm.fitted(table, 4)
    got = {r.word: 10.0 ** r.p for r in table.mapInArrow(lambda it: cm.probability_batches(it, gates, 4), "word string, c long, p float").collect()}
    assert 0 < sum(p for w, p in got.items() if len(w) == 1) <= 1 + 1e-6 and got["abc"] > got["qxj"]


def plain_score(text, static):
    """The text's log10 probability, token by token, as the module says it."""
    words = [w.decode() for w in tokens(text)]
    paths = []
    for speed in cm.SPEEDS:
        for paired in (False, True):
            seen, pairs, followed, total = collections.Counter(), collections.Counter(), collections.Counter(), 0.0
            before = None
            for at, w in enumerate(words):
                p = (seen[w] + speed * static[w]) / (at + speed)
                if paired:
                    p = (pairs[before, w] + cm.PAIRED * p) / (followed[before] + cm.PAIRED)
                total += math.log10(p)
                seen[w] += 1
                pairs[before, w] += 1
                followed[before] += 1
                before = w
            paths.append(total)
    top = max(paths)
    return top + math.log10(sum(10 ** (x - top) for x in paths) / len(paths))


def test_scores_against_plain_python(spark):
    """The whole score from the words' own chances; order and repeats count, and so do bits per byte."""
    texts = ["alpha beta gamma delta " * 3, "delta alpha gamma beta beta alpha", "alpha beta alpha beta alpha beta", "beta beta beta alpha alpha alpha", "new words é", ""]
    df = data.make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in cm.score_texts(df, F.col("doc_id") >= 4).collect()}
    counts = collections.Counter(w for t in texts[:4] for w in (x.decode() for x in tokens(t)))
    total, distinct = sum(counts.values()), len(counts)
    words = sorted({w.decode() for t in texts for w in tokens(t)})
    table = cm.sharded(spark.createDataFrame([(w, counts[w]) for w in words], "word string, c long"), 1, 4)
    gates = cm.fitted(table, 4)
    mix = {r.word: 10.0 ** r.p for r in table.mapInArrow(lambda it: cm.probability_batches(it, gates, 4), "word string, c long, p float").collect()}
    static = {w: max(0, counts[w] - cm.DISCOUNT) / total + cm.DISCOUNT * distinct / total * mix[w] for w in words}
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(plain_score(t, static), abs=1e-4)
        assert rows[i].bits_per_byte == pytest.approx(-rows[i].score / math.log10(2) / max(1, len(t.encode())))
    assert rows[2].score > rows[3].score  # the same words in another order


def test_held_out_gain_over_base(spark):
    held = cm.op3_context_mixing(spark, "/root/testdata/sf0.1").where("held_out").select("score", "base_score", "n_tokens").collect()
    tokens_ = sum(r.n_tokens for r in held)
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens_ > 0.05


def test_contexts_are_counted_exactly_over_shards(spark):
    """Path sums equal brute-force counts of all words, whatever the number of shards; long words count as well."""
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 7))) for _ in range(400)} | {"a" * 300, "", "ab\x01"})
    rows = [(w, int(n)) for w, n in zip(words, rng.integers(0, 5, len(words)), strict=True)]
    weight = {w.encode() + b" ": round((1 + math.log2(n)) * 1024) / 1024 for w, n in rows if n}
    want = collections.Counter()
    for w, x in weight.items():
        for at in range(len(w)):
            for context in {0: w[:at]} | {k: (k, w[max(0, at - k):at], at < k) for k in (1, 2, 3, 4)}, :
                for k, c in context.items():
                    for bits in range(9):
                        want[k, c, bits, w[at] >> bits] += x
    counts = spark.createDataFrame(rows, "word string, c long")
    fits = []
    for shards in (1, 5):
        table = cm.sharded(counts, shards, 4)
        packed = pa.Table.from_pylist([r.asDict() for r in table.collect()], schema=cm.GATHERED)
        seen = 0
        for found, trie, sums in cm.opened(iter(packed.to_batches()), 4):
            texts = [w.encode() + b" " for w in found.column("word").to_pylist()]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for i in range(len(trie.node)):
                w, at = texts[trie.owner[i]], i - starts[trie.owner[i]]
                for p, k in enumerate((1, 2, 3, 4, 0)):
                    c = (k, w[max(0, at - k):at], at < k) if k else w[:at]
                    got = sums[p][:, trie.node[i]]
                    assert all(abs(got[bits] - want[k, c, bits, w[at] >> bits]) < 1e-2 for bits in range(9))
            seen += len(texts)
        assert seen == len(words)
        fits.append(cm.fitted(table, 4))
    assert np.allclose(fits[0].weights, fits[1].weights) and np.allclose(fits[0].map, fits[1].map)


def test_decisions_take_bounded_texts(spark):
    """A step's working arrays stand beside the whole batch, so that it is held to less than the batch."""
    from tickerloom.llm import common

    texts = ["ab " * 100_000 + str(k) for k in range(12)]
    whole = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(12))})
    sizes = []

    def decide(part):
        sizes.append(sum(map(len, part.to_pylist())))
        return np.array([t.endswith(("1", "5")) for t in part.to_pylist()])

    got = [n for b in common._kept_batches(iter([whole]), "text", decide) for n in b.column("n").to_pylist()]
    assert got == [1, 5, 11] and sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1 << 20


def test_every_stage_begins_with_heaps_given_back(spark, tmp_path):
    import corpus_pipeline

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, docs, sf)
        assert collections() > before
