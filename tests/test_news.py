"""Cleaning, tagging, weights, gate, de-duplication, sentiment blending."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import matching, text as X, timing as T
from tickerloom.operators import dedup, normalize as N, scoring, sentiment as S
from tickerloom.operators.news import prepare_news
from tickerloom.settings import SOURCE_WEIGHTS, TAG_PATTERNS


def one(spark, value, *cols):
    df = spark.createDataFrame([(value,)], "x string")
    return tuple(df.select(*[c(F.col("x")).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0])


def test_gate_boundaries(spark):
    stamps = ["2024-03-01 15:29:59", "2024-03-01 15:30:00", "2024-03-01 23:59:59", "2024-12-31 16:00:00", "junk"]
    df = spark.createDataFrame([(s,) for s in stamps], "x string")
    got = [r[0] for r in df.select(T.gated_date(T.parse_market("x"))).collect()]
    assert got == [dt.date(2024, 3, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 2), dt.date(2025, 1, 1), None]


@pytest.mark.parametrize("text, market, utc", [
    ("2024-03-01 10:00:00", "2024-03-01 10:00:00", "2024-03-01 10:00:00"),
    ("2024-03-01T10:00:00Z", "2024-03-01 15:30:00", "2024-03-01 10:00:00"),
    ("2024-03-01T10:00:00+05:30", "2024-03-01 10:00:00", "2024-03-01 04:30:00"),
    ("2024-03-01 10:00:00.250-0400", "2024-03-01 19:30:00", "2024-03-01 14:00:00"),
    ("2024-03-01", "2024-03-01 00:00:00", "2024-03-01 00:00:00"),
    ("02-01-2024 09:15", "2024-01-02 09:15:00", "2024-01-02 09:15:00"),
    ("", None, None),
])
def test_time_zones(spark, text, market, utc):
    got = one(spark, text, T.parse_market, T.parse_utc)
    assert tuple(str(v) if v else None for v in got) == (market, utc)


def test_parsing_does_not_depend_on_the_session_zone(spark):
    skipped = "2024-03-10 02:30:00"  # does not exist in New York
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert str(one(spark, skipped, T.parse_naive)[0]) == skipped
        assert str(one(spark, skipped + "Z", T.parse_market)[0]) == "2024-03-10 08:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strip_removes_what_python_removes(spark):
    text = "\u00a0\u2003\x1f a \u3000b\u200b \t\u2028"
    assert one(spark, text, X.strip) == (text.strip(),)


def test_wall_date_ignores_the_zone(spark):
    assert one(spark, "2024-03-01 00:00:00+05:30", T.wall_date) == (dt.date(2024, 3, 1),)


@pytest.mark.parametrize("headline, tag", [
    ("Infosys, Wipro and TCS", "WIPRO"), ("hdfc bank beats icici bank", "ICICIBANK"), ("STATE BANK and HDFC", "SBIN"),
    ("nothing here", ""), (None, ""), ("tata motors up", "TATAMOTORS"),
])
def test_last_pattern_wins(spark, headline, tag):
    assert one(spark, headline, lambda c: matching.last_pattern_tag(c, TAG_PATTERNS)) == (tag,)


@pytest.mark.parametrize("source, weight", [
    ("Reuters India", 1.0), ("moneycontrol_hindi", 0.8), ("MoneyControl via Syndicated", 0.8), ("the default feed", 0.5),
    ("unknown", 0.5), ("Syndicated", 0.3),
])
def test_first_weight_key_wins(spark, source, weight):
    assert one(spark, source, lambda c: matching.source_weight(c, SOURCE_WEIGHTS)) == (weight,)


def test_cut_order_matters_when_characters_vanish(spark):
    body = "\r" * 10 + "a" * 495 + "\n" + "b" * 20
    first, last = one(spark, body, X.cut_then_clean, X.clean_then_cut)
    assert first == "a" * 490 and last == "a" * 495 + " " + "b" * 4
    exact = "c" * 500
    assert one(spark, exact, X.cut_then_clean, X.clean_then_cut) == (exact, exact)
    assert len(one(spark, "c" * 501, X.clean_then_cut)[0]) == 500


def test_tidy_and_newline_rules(spark):
    assert one(spark, "\t a\r\nb \n", X.tidy, X.drop_breaks, X.newline_to_space) == ("a  b", "\t a b  ", "\t a\r b  ")
    assert one(spark, None, X.tidy) == ("",)


def test_article_key_uses_nan_for_null_and_blank_for_missing(spark):
    df = spark.createDataFrame([(None, "h"), ("u", "h")], "url string, headline string")
    got = [r.row_hash for r in dedup.with_row_hash(df).collect()]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    assert got == [md5("nanh"), md5("uh")]
    assert dedup.with_row_hash(df.select("headline")).first().row_hash == md5("h")


@pytest.mark.parametrize("deva, total, label", [
    (0, 20, "en"), (1, 20, "en"), (11, 200, "hinglish"), (169, 200, "hinglish"), (17, 20, "hi"), (20, 20, "hi"),
])
def test_language_boundaries(spark, deva, total, label):
    text = "क" * deva + "x" * (total - deva)
    df = X.detect_language(spark.createDataFrame([(text,), ("  ",), (None,)], "x string"), "x", "lang")
    assert [r.lang for r in df.collect()] == [label, "unknown", "unknown"]


def test_same_article_survives_under_two_tickers(spark):
    rows = [("AAA", "u", "h", "2024-01-01 10:00:00", 1), ("aaa", "u", "h", "2024-01-05 10:00:00", 2),
            ("BBB", "u", "h", "2024-01-01 16:00:00", 3), ("CCC", "u", "h", "2024-01-01 16:00:00", 4),
            ("BBB", None, "h", "no date", 5)]
    raw = spark.createDataFrame(rows, "ticker string, url string, headline string, datetime string, n int")
    got = prepare_news(raw, ["aaa", "BBB"], ["n"]).orderBy("n").collect()
    assert [(r.ticker, r.n, r.trade_date) for r in got] == [
        ("AAA", 1, dt.date(2024, 1, 1)), ("BBB", 3, dt.date(2024, 1, 2))]
    assert {(r.lang, r.source, r.body) for r in got} == {("unknown", "unknown", "")}


def test_headline_mentions_replace_a_missing_ticker_column(spark):
    raw = spark.createDataFrame([("itc and sbin rise", "2024-01-01"), (None, "2024-01-01"), ("other", "2024-01-01")],
                                "headline string, date string")
    got = prepare_news(raw, ["ITC", "SBIN"], ["date"]).collect()
    assert sorted(r.ticker for r in got) == ["ITC", "SBIN"]


def test_news_without_time_column_is_an_error(spark):
    with pytest.raises(ValueError):
        prepare_news(spark.createDataFrame([("a", "h")], "ticker string, headline string"), ["a"], ["headline"])


def test_a_copy_group_of_a_third_of_all_rows_is_cut_before_the_shuffle(spark):
    n = 30_000
    df = spark.range(n).selectExpr(
        "'T' as ticker", "if(id % 3 = 0, 'copy', cast(id as string)) as headline", "id as n")
    out = dedup.dedup_articles(df, ["n"])
    assert out.count() == 20_001 - 0 and out.filter("headline = 'copy'").first().n == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def blended(spark, en, hi, unknown=0):
    rows = [("A", dt.date(2024, 1, 1), "en", "reuters", 0.6, 0.2, 0.2)] * en
    rows += [("A", dt.date(2024, 1, 1), "hi", "syndicated", 0.1, 0.8, 0.1)] * hi
    rows += [("A", dt.date(2024, 1, 1), "unknown", "reuters", 0.9, 0.05, 0.05)] * unknown
    df = spark.createDataFrame(
        rows, "ticker string, trade_date date, lang string, source string, pos double, neg double, neu double")
    return S.daily_sentiment(df).collect()[0]


@pytest.mark.parametrize("n, weight", [(0, 0.0), (2, 0.0), (3, 0.5), (5, 5 / 6), (6, 1.0), (9, 1.0)])
def test_sparse_class_gate(spark, n, weight):
    r = blended(spark, 2, n)
    assert r.hi_weight == pytest.approx(weight) and r.hi_count == n
    assert r.pos == pytest.approx((1 - weight) * 0.6 + weight * 0.1)


def test_day_of_unknown_language_is_neutral(spark):
    r = blended(spark, 0, 0, unknown=3)
    assert (r.pos, r.neg, r.neu, r.hi_count) == (0.0, 0.0, 1.0, 0)


def test_missing_first_class_is_neutral_in_the_blend(spark):
    r = blended(spark, 0, 3)
    assert r.neu == pytest.approx(0.5 * 1.0 + 0.5 * 0.1)


def test_weights_shape_the_daily_mean(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day, "en", "Reuters", 1.0, 0.0, 0.0), ("A", day, "en", "syndicated", 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(
        rows, "ticker string, trade_date date, lang string, source string, pos double, neg double, neu double")
    r = S.daily_sentiment(df).collect()[0]
    assert r.pos == pytest.approx(1.0 / 1.3) and r.neg == pytest.approx(0.3 / 1.3)


def test_rolling_counts_news_days_not_calendar_days(spark):
    days = [1, 2, 20, 21, 40]
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(d), 0.0, 0.0) for d in days]
    daily = spark.createDataFrame(rows, "ticker string, trade_date date, pos double, neg double, neu double")
    got = [r.pos_3d for r in S.rolling_sentiment(daily).orderBy("trade_date").collect()]
    assert got == pytest.approx([1, 1.5, 23 / 3, 43 / 3, 27])


def test_header_rules(spark):
    df = spark.createDataFrame([("a", "b")], " Pub Date string, TickER string".replace(" Pub Date", "`Pub Date`"))
    assert N.snake_headers(df).columns == ["pub_date", "ticker"]
    assert N.lower_headers(df).columns == ["pub date", "ticker"]
    both = spark.createDataFrame([("a", "b", "c")], "summary string, body string, symbol string")
    assert N.rename_variants(both).columns == ["summary", "body", "ticker"]
    two = spark.createDataFrame([("a", "b")], "summary string, description string")
    assert N.rename_variants(two).columns == ["body", "description"]


def test_price_table_checks_columns(spark):
    with pytest.raises(ValueError, match="close"):
        N.price_table(spark.createDataFrame([("2024-01-01", "1")], "date string, open string"))


def test_unknown_layout_is_an_error(spark):
    with pytest.raises(ValueError):
        N.to_master(spark.createDataFrame([("a",)], "headline string"), "x.csv", "other")


def test_scores_sum_to_one_and_blank_text_is_neutral(spark):
    words = scoring.WordLists(("good", "up"), ("bad",))
    df = spark.createDataFrame([("Good, good BAD news", "en"), ("", "en"), (None, "hi"), ("good", "unknown")],
                               "t string, lang string")
    got = [tuple(r)[2:] for r in scoring.score_by_language(df, "t", "lang", words, words).collect()]
    assert got[0] == pytest.approx((0.5, 0.25, 0.25)) and got[1:] == [(0.0, 0.0, 1.0)] * 3
    assert all(sum(r) == pytest.approx(1.0) for r in got)


def test_model_scorer_runs_in_batches(spark):
    import pandas as pd

    def load():
        return lambda texts: pd.DataFrame({"neg": 0.0, "pos": texts.str.len() / 10, "neu": 0.0}, index=texts.index)

    df = spark.createDataFrame([("abcde",), (None,)], "t string")
    got = [r.s.pos for r in df.select(scoring.model_scorer(load)("t").alias("s")).collect()]
    assert got == [0.5, 0.0]
