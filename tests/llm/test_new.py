"""Spectral whitening, URL rules, spelling variants."""

import collections
import math

import numpy as np
import pytest

from tickerloom.llm import spectral_whitening as sw
from tickerloom.llm import spectrum
from tickerloom.llm import spelling_trie as trie
from tickerloom.llm import url_rules as ur

from . import conftest as data
from .conftest import SF


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "plain": np.random.default_rng(3).exponential(size=30), "tied": [9, 5, 5, 5, *range(20)], "close": [7, 3 * (1 + 1e-10), 3, *np.linspace(0, 1, 20)],
    "low rank": [4, 2, 1] + [0] * 20, "equal": [1] * 20, "scales": [1e9, 1, *np.full(18, 1e-6)], "negative": [-3, -2, -1, 5], "zero": [0] * 4, "one": [2],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs_and_counts(name):
    a = symmetric(SPECTRA[name])
    lower, diag, off, order = spectrum.factor(a)
    d = np.diag(diag) + np.diag(off[:-1], 1) + np.diag(off[:-1], -1)
    assert np.allclose(lower @ d @ lower.T, a[order][:, order])
    want = np.sort(SPECTRA[name])[::-1]
    assert all(spectrum.above(a, s) == (want > s).sum() for s in (-2.5, -0.5, 0.31, 0.77, 2.5, 4.2, 6.1))
    values, vectors = spectrum.leading(a, 8)
    if name == "zero":
        assert not len(values)
        return
    top = want[:8]
    scale = np.abs(want).max()
    assert np.abs(values - top).max() <= 1e-13 * scale and np.abs(vectors.T @ vectors - np.eye(len(top))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale


def test_indefinite_pivots_need_blocks():
    a = np.array([[0.0, 1, 0], [1, 0, 2], [0, 2, 0]])
    assert spectrum.above(a, 0) == 1 and spectrum.above(a, -1e-9) == 2


def check_whitening(rows, vectors):
    """All columns against numpy on the distinct grid vectors."""
    grid = {k: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for k, v in enumerate(vectors)}
    x = np.array(sorted(set(map(tuple, grid.values()))))
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    by = collections.Counter()
    for r in rows:
        g, c = grid[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(g, total, strict=True))
        assert abs(r.whitened) == pytest.approx(abs((g - total / n) @ axes[:, c] / math.sqrt(e[c])), abs=1e-6)
        assert r.explained == pytest.approx(e[c] / v.trace(), rel=1e-9) and r.identity_error < 1e-8
        by[r.vec_id] += 1
    return by


def test_whitening_against_numpy(spark):
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    by = check_whitening(sw.op11_spectral_whitening(spark, SF).collect(), [e[i] for i in range(len(e))])
    assert set(by) == set(e) and set(by.values()) == {16}


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = np.random.default_rng(5).normal(size=(40, 3)).tolist()
    rows = [(k, v, "c") for k, v in enumerate(good)] + [
        (0, good[0], "c"), (None, good[1], "c"), (90, None, "c"), (91, [], "c"), (92, [1.0, nan, 0.0], "c"), (93, [inf, 0.0, 0.0], "c"),
        (94, [None, 0.0, 0.0], "c"), (95, [1.0, 2.0], "c"), (96, [1.0, 2.0, 3.0, 4.0], "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = sw.whitened(df, sw.fit(df)).collect()
    by = check_whitening([r for r in got if r.vec_id is not None], good)
    assert by == {k: 6 if k == 0 else 3 for k in range(40)} and sum(r.vec_id is None for r in got) == 3


def test_whitening_without_variance(spark):
    ddl = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [0.5, 0.5])] * 3, [(1, None)]):
        df = spark.createDataFrame(rows, ddl)
        assert sw.whitened(df, sw.fit(df)).collect() == []
    line = spark.createDataFrame([(k, [float(k), 1.0, float(k)]) for k in range(9)], ddl)
    assert {(r.component, round(r.explained, 9)) for r in sw.whitened(line, sw.fit(line)).collect()} == {(1, 1.0)}


def test_whitening_of_huge_entries(spark):
    """Exact sums beyond 64 bits; deviations that no long holds are NULL, and values off the grid saturate."""
    df = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [1e300, 2.0])], "vec_id long, embedding array<double>")
    got = sw.whitened(df, sw.fit(df)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(r.deviation is None and math.isfinite(r.whitened) for r in got)
    assert sw.deviations(np.array([[3, 4]]), 2, (1, 1)) == [25 + 49]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(counts, ratio=5):
    around = {a: {b for b in counts if near(a, b)} for a in counts}
    form = {}
    for a, others in around.items():
        b = min(others, key=lambda w: (-counts[w], w), default=None)
        form[a] = b if b is not None and counts[b] >= ratio * counts[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return {(a, form[a], root(a), counts[a], len(around[a]), counts.get(form[a])) for a in counts}


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_variants_against_all_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    words = {"".join(rng.choice(list("abé"), rng.integers(0, 8))) for _ in range(250)}
    words |= {"a" * 60, "a" * 61, "a" * 59 + "b", "b" + "a" * 60, "tést", "tèst", "a\U0001F600b", "a\U0001F601b", "ab\u00ff"}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.choice([1, 2, 5, 12, 60, 400, 3000], len(words)), strict=True)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = trie.variants(df, levels=levels).collect()
    assert {tuple(r) for r in got} == brute_variants(counts) and len(got) == len(counts)
    assert any(r.form != r.root for r in got if r.form is not None)


def test_variants_of_odd_words(spark):
    ddl = "word string, n long, form string, node int"
    assert trie.variants(spark.createDataFrame([], ddl)).collect() == []
    rows = [("apple", 3, "x", 1), ("apple", 2, "x", 1), (None, 9, "x", 1), ("appl\u0000", 4, "x", 1), ("appla", 25, "x", 1), ("applb", 25, "x", 1)]
    got = {tuple(r) for r in trie.variants(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        ("apple", "appla", "appla", 5, 2, 25), ("appl\u0000", None, "appl\u0000", 4, 0, None), ("appla", None, "appla", 25, 2, None), ("applb", None, "applb", 25, 2, None),
    }


def test_runs_and_dropped_points(spark, odd, none):
    import re
    import zlib

    assert trie.runs(none, 1).collect() == []
    texts = data.make(spark, [(1, "Été-MAISON_maison ÿÀ÷", "fr", "a"), (None, "Grüße", "de", "b"), (2, None, "de", "b")])
    found = sorted((str(r.doc_id), r.word) for r in trie.runs(texts, 1).collect())
    assert found == sorted([("1", "Été"), ("1", "maison"), ("1", "maison"), ("1", "ÿÀ÷"), ("None", "grüße")])
    runs = [r.word for r in trie.dropped_point(trie.runs(odd, 3), 3).collect()]
    want = []
    for i, t, *_ in data.ODD:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]{3,}", t or ""):
            w = w.lower()
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want.append(w if h % 3 else w[:h % len(w)] + w[h % len(w) + 1:])
    assert sorted(runs) == sorted(want)


URLS = (
    ["http://shop.example.org/sale/%d?ref=x" % k for k in range(12)] + ["http://shop.example.org/news/%d" % k for k in range(12)]
    + ["https://a-b.c.example.org/Sale/Now/%d#top" % k for k in range(6)]
)


def test_mined_rules_against_counting(spark):
    rows = [(u, "block" if "sale" in u.lower() and k % 7 else "allow") for k, u in enumerate(URLS)]
    got = ur.mine(spark.createDataFrame([*rows, ("http://x.org/", None), (None, "allow"), ("http://sale.org/", "other")], "url string, label string"), support=0.1, confidence=0.7, items=20)
    baskets = [(ur.tokens(u), label) for u, label in [*rows, (None, "allow")]]
    need, sets = math.ceil(0.1 * len(baskets)), {}
    from itertools import combinations

    for found, _ in baskets:
        for k in (1, 2, 3):
            for c in combinations(sorted(found), k):
                if c not in sets:
                    sets[c] = collections.Counter(label for f, label in baskets if set(c) <= f)
    sure = {(c, x): (n[x], sum(n.values())) for c, n in sets.items() for x in ("allow", "block") if n[x] >= need and n[x] >= 0.7 * sum(n.values())}
    want = {(c, x, *s) for (c, x), s in sure.items() if not any(set(d) < set(c) and x == y and t[0] * s[1] >= s[0] * t[1] for (d, y), t in sure.items())}
    assert set(got.rules) == want and want and got.default == "allow"


def test_only_telling_tokens_are_mined(spark):
    rows = [("http://h.org/" + "/".join(f"w{k}" for k in range(60)) + ("/bad" if n % 2 else "/good"), "block" if n % 2 else "allow") for n in range(40)]
    got = ur.mine(spark.createDataFrame(rows, "url string, label string"), items=4)
    assert {(r[0], r[1]) for r in got.rules} == {(("p:bad",), "block"), (("p:good",), "allow")}
    assert got.judge({"p:bad"}) == ("block", "p:bad", 1.0) and got.judge({"p:w1"})[0] == got.default


@pytest.mark.parametrize("width", [14, 60])
def test_all_frequent_tokens_are_mined(spark, width):
    """More tokens a row than any bound on them: all single tokens and all combinations that tell more, against counting."""
    rng = np.random.default_rng(width)
    rows = []
    for k in range(60):
        words = [f"w{i:02d}" for i in range(width) if rng.random() < 0.7]
        sure = "w01" in words and "w02" in words or "w03" not in words and "w04" in words
        rows.append(("http://h.org/" + "/".join(words), "block" if sure and k % 9 else "allow"))
    baskets = [(ur.tokens(u), label) for u, label in rows]
    names = sorted(set().union(*[f for f, _ in baskets]))
    has = np.array([[t in f for t in names] for f, _ in baskets])
    label = np.array([x for _, x in baskets])
    from itertools import combinations

    need, sure = math.ceil(0.1 * len(rows)), {}
    for k in (1, 2, 3):
        for c in combinations(range(len(names)), k):
            hit = has[:, c].all(axis=1)
            for x in ur.LABELS:
                good, n = int((hit & (label == x)).sum()), int(hit.sum())
                if good >= need and good >= 0.8 * n:
                    sure[c, x] = good, n
    want = set()
    for (c, x), (good, n) in sure.items():
        fewer = [sure.get((d, x)) for k in range(1, len(c)) for d in combinations(c, k)]
        if not any(s and s[0] * n >= good * s[1] for s in fewer):
            want.add((tuple(names[i] for i in c), x, good, n))
    got = ur.mine(spark.createDataFrame(rows, "url string, label string"), support=0.1)
    assert set(got.rules) == want and len(got.rules) == len(want) and {t for c, *_ in want for t in c} >= {"p:w01", "p:w02"}


def test_listed_rules():
    listed = ur.RuleList(ur.LISTED)
    cases = {
        "http://www.EXAMPLE.com/en/1": "www.example.com/en/", "http://m.example.com/en/": "example.com/en/", "http://example.com/en": "com/", "http://a.com": None,
        "http://xexample.com/en/": "com/", "x://net/es/?/fr/": "net/es/", "http://a.net/en/": None, "http://b.net?/es/": None, "com/": None, "http://www.example.com#/en/": None,
    }
    for url, rule in cases.items():
        _, host, path, _, _ = ur.parts(url)
        found = listed.find(host, path)
        assert (found and found[0]) == rule, url
    assert ur.parts("http://A.b/C?x=1#y?z/")[1:] == ("a.b", "/C", "x=1", True)


def test_urls_of_odd_rows(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (None, "http://a.com/x", "h"), (4, "http://a.net/fr/", "h"), (4, "http://a.net/fr/", "h"), (5, "http://" + "a." * 50_000 + "net/es/" + "b/" * 50_000, "h"), (6, "http://ü.com/É", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = ur.judged(pages, ur.LISTED, ur.mine(ur.listed_labels(pages, ur.LISTED))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all((by[k].host, by[k].path, by[k].rule) == ("", "", None) for k in (1, 2, 3)) and by[None].verdict == "allow"
    assert by[4].verdict == by[5].verdict == "block" and by[5].rule == "net/es/" and (by[6].host, by[6].path) == ("ü.com", "/É")
    empty = pages.limit(0)
    assert ur.judged(empty, ur.LISTED, ur.mine(ur.listed_labels(empty, ur.LISTED))).collect() == []
    assert {r.verdict for r in ur.judged(pages.where("page_id = 2"), [], ur.mine(ur.listed_labels(empty, []))).collect()} == {"allow"}
