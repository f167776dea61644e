"""License and secret scans, token counts."""

import hashlib
import re

import pytest
from tickerloom.llm import license_scan as lic
from tickerloom.llm import secret_crf as crf
from tickerloom.llm import token_counts as tok

from . import conftest as data
from .conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base_of(t):
    words = WORDS.findall(lower(t))
    places = []
    for phrase, label in lic.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), places


def check_licenses(rows, texts):
    for r in rows:
        n, places = base_of(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licenses_equal_brute_force(docs, texts):
    rows = lic.license_scan(docs).collect()
    assert len(rows) == len(texts)
    check_licenses(rows, texts)


def test_licenses_of_odd_rows(odd, none):
    rows = lic.license_scan(odd).collect()
    assert len(rows) == len(data.ODD)
    check_licenses(rows, {r[0]: r[1] for r in data.ODD})
    assert lic.license_scan(none).collect() == []


def test_own_labels_need_the_mandatory_phrase(spark):
    df = data.make(spark, [
        (1, "Licensed under CC BY-NC 4.0.", "en", "a"), (2, "Licensed under CC BY", "en", "a"),
        (3, "MIT licenses; license MIT", "en", "a"), (4, "mit license mit license", "en", "a"),
        (5, "licensed under the apache software license", "en", "a"),
    ])
    got = {r.doc_id: r for r in lic.license_scan(df).collect()}
    assert got[1].labels == "cc-by,cc-by-nc" and got[2].labels == "cc-by" and got[3].labels == "" and got[5].labels == ""
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 2)


def test_a_verified_phrase_gives_its_label_whatever_stands_around_it(spark):
    names = {
        "Mozilla Public License 2.0": "mpl", "Eclipse Public License 2.0": "epl", "CC BY-NC 3.0": "cc-by,cc-by-nc", "CC BY-SA 3.0": "cc-by,cc-by-sa",
        "CC BY-ND 3.0": "cc-by,cc-by-nd", "CC0 1.0": "cc0", "All rights reserved.": "proprietary", "released into the public domain": "public-domain",
    }
    rows = lic.license_scan(data.make(spark, [(i, t, "en", "a") for i, t in enumerate(names)])).collect()
    assert {r.doc_id: r.labels for r in rows} == dict(enumerate(names.values()))
    assert all(0 < r.score <= 1 and r.n_matches > 0 for r in rows)


def test_score_tells_a_whole_notice_from_a_mention(spark):
    notices = [n for n, _, _ in lic.TEMPLATES] + list(lic.NOTICES.values())
    whole = [(i, f"foo bar {n.title()}. baz", "en", "a") for i, n in enumerate(notices)]
    mentions = [(1000 + i, f"we do not speak of {p} here", "en", "a") for i, (p, _) in enumerate(lic.BASE)]
    filler = [(2000 + i, "the quick brown fox and other words", "en", "a") for i in range(200)]
    got = {r.doc_id: r for r in lic.license_scan(data.make(spark, whole + mentions + filler)).collect()}
    assert all(abs(got[i].score - 1) < 1e-9 and got[i].labels for i, *_ in whole)
    assert all(0 < got[i].score < 0.6 and got[i].n_base == 1 and got[i].first_word == 5 for i, *_ in mentions)
    assert all(got[i].score == 0 for i, *_ in filler)


def test_lookup_equals_a_plain_search_for_every_number_of_words():
    import random

    rng = random.Random(4)
    found = lic.templates()
    pool = sorted({w for t in found for w in t.words})
    for _ in range(200):
        words = [w for _ in range(rng.randint(0, 6)) for w in (rng.choice(found).key if rng.random() < 0.5 else rng.choices(pool, k=3))]
        want = sorted((k, at - t.key_at) for k, t in enumerate(found) for at in range(len(words)) if tuple(words[at:at + len(t.key)]) == t.key)
        holders = {w: rng.randint(0, 50) for w in pool}
        for rare in (1, 2, 3, 9):
            got = lic.RareIndex(found, holders, 50, rare).matches(words)
            assert sorted((k, s) for k, s, _ in got) == want and all(0 < x <= 1 for *_, x in got)


def spans_of(t):
    t = t or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def check_secrets(rows, texts):
    for r in rows:
        found = spans_of(texts[r.doc_id])
        listed = ",".join(f"{crf.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("crf")) == listed


@pytest.fixture(scope="module")
def field(spark):
    return crf.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_secrets_equal_brute_force(docs, texts, field):
    check_secrets(crf.secret_scan(docs, field).collect(), texts)


def test_secrets_of_odd_rows(odd, none, field):
    rows = crf.secret_scan(odd, field).collect()
    assert len(rows) == len(data.ODD)
    check_secrets(rows, {r[0]: r[1] for r in data.ODD})
    assert crf.secret_scan(none, field).collect() == []
    assert crf.fit(none) is None and crf.fit(odd) is not None and crf.secret_scan(odd, None).count() == len(data.ODD)


def test_secret_patterns_at_their_edges(spark, field):
    cases = {
        1: 'é😀 password = "abcdefgh"', 2: "token = secret: abcdefgh1", 3: "AKIA" + "A" * 12 + " AKIA" + "B" * 11,
        4: "f" * 31 + " " + "0" * 32, 5: "TOKEN='ABCD1234=='", 6: "ſecret = abcdefghij", 7: "api-key: 12345678", 8: "apikey:12345678 api_key=x",
    }
    rows = crf.secret_scan(data.make(spark, [(k, v, "en", "a") for k, v in cases.items()]), field).collect()
    check_secrets(rows, cases)


def test_field_finds_what_patterns_find_in_unseen_texts(spark, field):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000 AND doc_id < 6000").collect()
    texts = [r.text for r in rows]
    hit = want = extra = 0
    for t, spans in zip(texts, crf.field_spans(texts, field), strict=True):
        base = spans_of(t)
        want += len(base)
        hit += sum(any(a < y and x < b for a, b in spans) for x, _, y in base)
        extra += sum(not any(a < y and x < b for x, _, y in base) for a, b in spans)
    assert want > 100 and hit >= 0.95 * want and extra <= 0.05 * want


def test_field_finds_forms_that_no_pattern_has(texts, field):
    import numpy as np

    rng = np.random.default_rng(3)
    some = [t for t in texts.values() if t][:200]
    hit = want = wrong = 0
    for text, spans, decoys in (crf.seeded(t, rng) for t in some):
        got = crf.find_spans([text], field)[0]
        want += len(spans)
        covered = {p for a, b, _ in got for p in range(a, b)}
        hit += sum(covered.issuperset(range(x, y)) for x, y, _, _ in spans)
        wrong += sum(x in covered for x in decoys)
    assert want == 2 * len(some) and hit >= 0.9 * want and wrong <= 0.03 * want


def test_masking_leaves_nothing_of_a_key_around_a_find(field):
    text = "é the key sk_0123456789abcdef0123456789abcdefXYZ9q was used here"
    spans = crf.find_spans([text], field)[0]
    assert (text.index("0"), text.index("XYZ"), 2) in spans
    assert crf.masked(text, spans, "*").replace("*", "") == "é the key  was used here"


def test_uncovered_parts_equal_sets_of_positions():
    import random

    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 8))
        added = list(zip(cuts[0::2], cuts[1::2], strict=True))
        base = sorted((a, a + rng.randint(1, 20)) for a in rng.sample(range(60), 4))
        want = {p for a, b in added for p in range(a, b)} - {p for a, b in base for p in range(a, b)}
        got = crf.uncovered(added, crf._merged(base), "x" * 100)
        assert {p for a, b in got for p in range(a, b)} == want and sum(b - a for a, b in got) == len(want)
    assert crf.uncovered([(0, 9)], [(1, 7)], '"abcdef-+"') == []


def test_many_finds_in_one_text_take_linear_time(field):
    import time

    def seconds(n):
        text = "é " + "token=abcdefgh12 and " * n
        start = time.perf_counter()
        assert sum(k == 0 for _, _, k in crf.find_spans([text], field)[0]) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 16 * max(0.05, seconds(2_000))


def test_windows_cover_the_whole_text():
    import numpy as np

    feats = np.zeros((500, len(crf.SIZES)), np.int32)
    feats[470, 0] = 7 * 16 + 10
    got = crf._suspects(feats, 2, np.random.default_rng(0))
    assert 470 in got and len(got) <= 2 and len(crf._suspects(feats[:0], 2, np.random.default_rng(0))) == 0


def test_viterbi_equals_all_paths(field):
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(20):
        e = rng.normal(0, 6, (6, 3)).astype(np.float32)
        def total(path):
            return -1e9 if path[0] == crf.I else sum(e[i, t] for i, t in enumerate(path)) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))
        best = max(itertools.product(range(3), repeat=6), key=total)
        assert abs(total(best) - total(field.decode(e))) < 1e-3


def test_masking_keeps_rows_and_columns(odd, field):
    got = crf.mask_secrets(odd, field)
    assert got.columns == odd.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows[1] is None and rows[2] == "" and "longlonglong1" not in rows[6] and rows[6].startswith("the cat sat")
    assert crf.masked("ab SECRET cd", [(3, 9, 0), (4, 9, 2)], "*") == "ab * cd"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_the_library(spark, docs, texts, odd, none):
    path, library = tokenizer()
    special = ["a<|endoftext|> b", "  lead", "trail  ", "a  b\n c \n", " ", "  x  y z", "don't we'll 'tis", "a\x1c b\x85 c", "😀 é à"]
    df = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(special)], "doc_id long, text string"))
    want = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    rows = sorted(tok.token_counts(df, path).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    lengths = {}
    for i, t in want:
        n = len(library.encode(t, add_special_tokens=False)) if len(t) < 100_000 else None
        lengths.setdefault(i, set()).add((len(t.encode()), n))
    assert len(rows) == len(want)
    for r in rows:
        assert any(r.n_bytes == b and n in (None, r.n_tokens) for b, n in lengths[r.doc_id]), r
        assert r.over_limit == (r.n_tokens > 512)
    long_ = next(r for r in rows if r.doc_id == 6 and r.n_bytes == len(data.LONG))
    assert long_.n_tokens == len(library.encode(data.LONG, add_special_tokens=False))
    assert tok.token_counts(none, path).collect() == []


def test_queries_cover_the_tables(spark, texts):
    assert lic.op1_license_scan(spark, SF).count() == crf.op2_secret_crf(spark, SF).count() == tok.op9_token_counts(spark, SF).count() == len(texts)
