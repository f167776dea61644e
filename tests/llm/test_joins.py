"""Jaccard join, components, nearest neighbours, decontamination, source mix, pipeline."""

import collections
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from tickerloom.llm import components as cc
from tickerloom.llm import decontaminate as dec
from tickerloom.llm import hamming_search as ham
from tickerloom.llm import shingle_join as sj
from tickerloom.llm import source_mix as mix
from tickerloom.llm.license_scan import words_in

from . import conftest as data
from .conftest import SF

SMALL = "/root/testdata/sf0.01"


def sets_of(texts, n):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, t):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * t.denominator >= max(len(x), len(y)) * t.numerator:
                c = len(x & y)
                if c * t.denominator >= (len(x) + len(y) - c) * t.numerator:
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def check_join(spark, texts, t, n):
    df = data.make(spark, [(i, x, "en", "a") for i, x in texts.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sj.jaccard_components(df, t, n).collect()}
    sets = sets_of(texts, n)
    root = brute_components(sets, t)
    assert got == {i: (len(sets[i]), root[i]) for i in texts}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_join_equals_brute_force(spark, texts):
    check_join(spark, texts, Fraction(9, 10), 3)


@pytest.mark.parametrize(("t", "n"), [(Fraction(9, 10), 3), (Fraction(4, 5), 5)])
def test_join_of_near_copies(spark, t, n):
    """A large group of near copies with and without its origin, chains at the threshold, copies, short texts."""
    rng = random.Random(4)
    texts = {}
    for origin in range(3):
        words = [f"o{origin}w{i}" for i in range(150)]
        for k in range(60):
            texts[len(texts)] = edited(rng, words, rng.randrange(0 if origin else 1, 5))
    chain = [f"c{i}" for i in range(80)]
    for k in range(12):
        texts[len(texts)] = " ".join(chain[k:k + 60])
    for k in range(8):
        texts[len(texts)] = ["a b c", "A b C", "a b", "a", "", None, "a b c d", "\t"][k]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    check_join(spark, dict(zip(ids, texts.values(), strict=True)), t, n)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in found.split() if "/shuffle_" in f}


def near_copies_of_two(rng):
    texts = [edited(rng, [f"o{origin}w{i}" for i in range(150)], rng.randrange(5)) for origin in range(2) for _ in range(40)]
    return dict(enumerate(texts + texts[:3] + [f"alone {i} and on its own" for i in range(20)]))


def test_join_shuffles_prefix_tokens_once_and_keeps_no_shuffle_files(spark, monkeypatch):
    plans, whole = {}, sj.stored

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        before = shuffle_files(spark)
        out = whole(df, purpose)
        end = time.time() + 20
        while (left := shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.2)
        assert not left, purpose
        return out

    monkeypatch.setattr(sj, "stored", noted)
    check_join(spark, near_copies_of_two(random.Random(6)), Fraction(4, 5), 5)
    assert plans["shingle-shared"].count("Exchange ") == 1


@pytest.mark.parametrize("ids", [0, 10, 1000])
def test_join_of_more_ids_than_are_broadcast(spark, monkeypatch, ids):
    """Also with hot tokens and with flocks of many blocks."""
    monkeypatch.setattr(sj, "BROADCAST_IDS", ids)
    monkeypatch.setattr(sj, "HOT", 8)
    monkeypatch.setattr(sj, "BLOCK", 7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check_join(spark, near_copies_of_two(random.Random(7)), Fraction(4, 5), 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_of_an_id_with_two_texts(spark):
    """Its rows' sets are compared each and link what they are like, also where one of them is another document's copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(2, a), (4, a), (4, b), (5, b + " more"), (6, c), (7, c + " more"), (7, c + " more"), (8, ""), (8, c + " most")]
    got = {(r.doc_id, r.component_id) for r in sj.jaccard_components(data.make(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {(2, 2), (4, 2), (5, 2), (6, 6), (7, 6), (8, 6), (8, 8)}


def test_join_of_odd_rows(odd, none):
    rows = sj.jaccard_components(odd).collect()
    assert len(rows) == len(data.ODD)
    got = collections.Counter((r.doc_id, r.component_id) for r in rows)
    assert got[4, 4] == 2 and got[5, 4] == 1 and got[9, 8] == 1 and got[1, 1] == 1 and got[None, None] == 1
    assert sj.jaccard_components(none).collect() == []


def test_least_common_and_prefix_are_exact():
    for t in (Fraction(9, 10), Fraction(4, 5)):
        for a in range(1, 60):
            for b in range(1, 60):
                want = min((c for c in range(min(a, b) + 1) if Fraction(c, a + b - c) >= t), default=None)
                assert want is None or want == sj.least_common(a, b, t)
            assert sj.prefix_length(a, t) == a - min(c for c in range(a + 1) if Fraction(c) >= t * a) + 1


def test_components_of_paths_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(i, j) for i in range(200, 212) for j in range(200, i)] + [(5, 5), (None, 3)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in range(200, 212)}
    assert got == want
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_nearest(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in [i for i in range(len(rows)) if asked(ids[i])]:
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(rows, want):
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == len(want[q]) and [r[1] for r in found] == sorted((r[1] for r in found), reverse=True)
    return np.mean([i in {v for v, _ in got[q]} for q in want for i, _ in want[q]]), got


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    share, got = recall(ham.op4_hamming_search(spark, "/root/testdata/sf0.1").collect(), brute_nearest(rows, lambda i: i % 50 == 0, 5))
    assert share >= 0.9


def test_nearest_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    sound = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(i, [1.0] * 8) for i in range(60, 100)] + [(100, [2.0] * 8)]
    bad = [(200, None), (250, [0.0] * 8), (300, [1.0, None] + [1.0] * 6), (350, [float("nan")] + [1.0] * 7), (400, [float("inf")] + [1.0] * 7), (450, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in sound + bad], "vec_id long, embedding array<double>, rank string, shard int")
    rows = ham.nearest(df, F.col("vec_id") % 10 == 0).collect()
    share, got = recall(rows, brute_nearest(sound, lambda i: i % 10 == 0, 5))
    assert share >= 0.9
    assert [v for v, _ in got[60]] == [61, 62, 63, 64, 65] and [v for v, _ in got[100]] == [60, 61, 62, 63, 64]
    few = spark.createDataFrame(sound[:3], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank) for r in ham.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ham.nearest(few.limit(0), F.col("vec_id") == 0).collect() == []


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    shard = ham.Shard(codes)
    for radius in (0, 3, 5, 6, 10, 32):
        far = ham.BITS[codes ^ codes[7]].sum(axis=1, dtype=np.int64)
        assert shard.within(codes[7], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_every_planted_item_is_found(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in dec.op6_decontaminate(spark, SF).collect()}
    words = {i: b" ".join(words_in(t)) for i, t in texts.items()}
    want = {(d, i) for i, t in items.items() for d, w in words.items() if b" " + b" ".join(words_in(t)) + b" " in b" " + w + b" "}
    assert want and want <= got
    for d, i in got - want:  # what else is found holds half of the item's word triples
        grams = dec.grams(words_in(items[i]), 3)
        assert len(grams & dec.grams(words[d].split(), 3)) >= 0.5 * len(grams)


def test_block_max_walk_equals_full_scoring():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)))) for i in range(300)]
    index = dec.BlockMaxIndex(items, 0.4)
    passages = [rng.choices(vocabulary, k=90) + items[k][1].split()[: rng.randrange(60)] for k in range(60)]
    ids = [np.array([index.terms[w.encode()] for w in p if w.encode() in index.terms]) for p in passages]
    admitted = set(index.admitted(np.repeat(np.arange(60), [len(x) for x in ids]), np.concatenate(ids)).tolist())
    for k, terms in enumerate(ids):
        score = collections.Counter()
        for t in set(terms.tolist()):
            for d, s in zip(index.items[t], index.shares[t], strict=True):
                score[d] += s
        want = {d for d, s in score.items() if s >= 0.4 - 1e-9}
        assert {d for d, _ in index.search(sorted(set(terms.tolist())))} == want
        assert not want or k in admitted


def test_decontamination_does_not_depend_on_blocks(spark, docs, monkeypatch):
    """One index or many: the same scores; items without an id count as well."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("item_id", F.when(F.col("item_id") % 3 != 0, F.col("item_id")))
    whole = {tuple(r) for r in dec.contaminated(docs, items).collect()}
    kept = {r.doc_id for r in dec.clean_only(docs, items).collect()}
    monkeypatch.setattr(dec, "BLOCK_CHARS", 2000)
    parts = {tuple(r) for r in dec.contaminated(docs, items).collect()}
    assert {r[:3] for r in whole} == {r[:3] for r in parts} and any(r[1] < 0 for r in whole)
    assert np.allclose(sorted(r[3] for r in whole), sorted(r[3] for r in parts))
    assert kept == {r.doc_id for r in dec.clean_only(docs, items).collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {r[0] for r in whole}


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Same text here. Same text here."), (2, None), (3, ""), (None, "tie"), (4, "tie"), (5, "Same text here. Same text here.")], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id if r.item_id > 0 else None) for r in dec.contaminated(odd, items).collect())
    assert got == collections.Counter([(4, 1), (4, 5), (5, 1), (5, 5), (8, 4), (9, 4), (8, None), (9, None)])
    assert dec.contaminated(none, items).collect() == dec.contaminated(odd, items.limit(0)).collect() == []
    kept = dec.clean_only(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 6, None, 7]))


def test_leak_on_a_passage_border(spark):
    rng = random.Random(5)
    item = " ".join(f"q{i}" for i in range(40)) + ". " + " ".join(f"a{i}" for i in range(10)) + "."
    noise = [f"n{i}" for i in range(300)]
    rows = [(k, " ".join(noise[:k] + item.split() + noise[k:]), "en", "a") for k in range(0, 120, 7)]
    rows += [(1000, " ".join(noise), "en", "a"), (1001, " ".join(noise[:50] + item.split()[:20] + noise[50:]), "en", "a"), (1002, item.upper().replace(" ", "!! "), "en", "a")]
    tests = spark.createDataFrame([(i, item if i == 7 else " ".join(rng.sample(noise, 30))) for i in range(9)], "item_id long, text string")
    got = {r.doc_id for r in dec.contaminated(data.make(spark, rows), tests).where("item_id = 7").collect()}
    assert got == {r[0] for r in rows} - {1000, 1001}


def test_mix_meets_targets(spark):
    rows = mix.op10_source_mix(spark, SMALL).collect()
    again = mix.op10_source_mix(spark, SMALL).collect()
    assert sorted(rows) == sorted(again)
    truth = {r.doc_id: (r.source, len((r.text or "").split())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes = collections.Counter()
    for s, n in truth.values():
        sizes[s] += n
    target = mix.targets_of(dict(sizes), sum(sizes.values()))
    taken, most = collections.Counter(), collections.Counter()
    for r in rows:
        s, n = truth[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - target[s]) < 1e-6 and r.taken in (0, n, 2 * n, 3 * n)
        taken[s] += r.taken
        most[s] = max(most[s], n)
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in sizes)


def test_targets_stop_at_three_times_a_source():
    got = mix.targets_of({"a": 1, "b": 100, "c": 100, None: 99}, 300)
    assert got["a"] == 3 and abs(sum(got.values()) - 300) < 1e-9
    assert got["b"] / 2 == pytest.approx(got["c"]) and got[None] / 5 == pytest.approx(got["c"])
    assert mix.targets_of({}, 0) == {} and mix.targets_of({"a": 0}, 0) == {"a": 0}


def test_flow_is_cheapest():
    """Against all integer flows of a small overlapping network."""
    import itertools

    cap, members, quota = {"x": 2, "y": 1, "z": 2}, {"x": ["a"], "y": ["a", "b"], "z": ["b"]}, {"a": 5, "b": 4}
    price = lambda used, c: sum((u // c) for u in range(used))  # noqa: E731  the k-th round costs k more: 0, 1, 3 in all
    cost = lambda used, c: sum(k * (k + 1) // 2 * max(0, min(c, used - k * c)) for k in range(3))
    best = None
    for xa, ya, yb, zb in itertools.product(range(7), range(4), range(4), range(7)):
        if xa <= 6 and ya + yb <= 3 and zb <= 6 and xa + ya <= 5 and yb + zb <= 4:
            key = (-(xa + ya + yb + zb), cost(xa, 2) + cost(ya + yb, 1) + cost(zb, 2))
            best = key if best is None else min(best, key)
    flow = mix.route(cap, members, quota, 3)
    used = {p: sum(v for (q, _), v in flow.items() if q == p) for p in cap}
    assert (-sum(flow.values()), sum(cost(used[p], cap[p]) for p in cap)) == best
    assert price(0, 1) == 0


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, "en", s) for i, s in enumerate(["a"] * 30 + ["b"] * 30 + ["a,b"] * 30)]
    df = data.make(spark, rows).withColumn("both", F.split("source", ","))
    taken, shares = mix.mix_sources(df, F.col("both"), weights=(1, 3))
    by = {r.pattern: r.n for r in taken.groupBy("pattern").agg(F.sum("taken").alias("n")).collect()}
    goal = {r.source: r.target for r in shares.collect()}
    assert goal == {"a": 225.0, "b": 675.0} and sum(by.values()) == pytest.approx(900, abs=20)
    assert by['["b"]'] + by['["a","b"]'] >= 655


def test_mix_of_odd_rows(odd, none):
    rows = mix.mixed_documents(odd).collect()
    assert len(rows) == len(data.ODD) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mix.mixed_documents(none).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its operator or brute force on the stage's own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [b" ".join(words_in(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.columns == docs.columns
        if name == "quality":
            bad = [i for i in before if truth.get(i) == 0]
            assert sum(i in after for i in bad) <= 0.1 * len(bad) and all(i in after for i in before if truth.get(i) == 1)
        if name == "near copies":
            root = brute_components(sets_of({i: r.text for i, r in before.items()}, 5), Fraction(4, 5))
            assert set(after) == {i for i in before if root[i] == i}
        if name == "decontamination":
            dirty = {i for i, r in before.items() if any(b" " + x + b" " in b" " + b" ".join(words_in(r.text)) + b" " for x in items)}
            assert dirty and not dirty & set(after) and len(before) - len(after) <= len(dirty) + 2
        if name == "secrets":
            from .test_scans import spans_of

            assert set(after) == set(before) and not any(spans_of(r.text) for r in after.values())
            assert all(r == before[i] for i, r in after.items() if not spans_of(before[i].text))
        docs = out
    assert pipe.run(spark, SMALL).count() == docs.count()
