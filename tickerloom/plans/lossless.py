"""Queries over file layouts, date layouts and the stage runner."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.timing import parse_utc
from ..operators import normalize as N, scoring
from ..session import materialize, shared_folder
from ..settings import PRICE_FEATURES, Settings
from ..sources import readers, writers
from . import stages, views as V
from .sql import r6, r6_all, with_views


def csv_master_roundtrip(spark, sf_dir):
    """Whole texts with quotes and line breaks through a file that has the master's name."""
    folder = shared_folder(spark, "master")
    d = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit('"first"\nsecond '), F.col("text")).alias("headline"), "source")
    writers.write_csv(d, f"{folder}/{readers.MASTER_NEWS}")
    back = readers.read_news(spark, folder)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5("headline").alias("text_key"))


# Text layout (Spark) and what it drops from the stamp (SQL), by doc_id.
LAYOUT_CASES = (
    ("EEE, dd MMM yyyy HH:mm:ss", " +0530", "stamp - INTERVAL 330 MINUTE"), ("dd/MM/yyyy HH:mm", "", "date_trunc('minute', stamp)"),
    ("dd-MM-yyyy", "", "date_trunc('day', stamp)"), ("MMM d, yyyy hh:mm a", "", "date_trunc('minute', stamp)"),
    ("yyyy-MM-dd'T'HH:mm", "", "date_trunc('minute', stamp)"), ("yyyyMMdd", "", "date_trunc('day', stamp)"),
    ("dd MMM yyyy HH:mm", "", "date_trunc('minute', stamp)"), ("yyyy/MM/dd HH:mm:ss", "", "stamp"),
    ("yyyy-MM-dd HH:mm:ss", " UTC", "stamp"), ("dd-MMM-yyyy", "", "date_trunc('day', stamp)"),
    ("MMMM dd, yyyy HH:mm", "", "date_trunc('minute', stamp)"), ("yyyy-MM-dd HH:mm:ss", " IST", "stamp - INTERVAL 330 MINUTE"),
    ("yyyy-MM-dd HH:mm:ss.SSS", "Z", "stamp"), ("dd/MM/yy", "", "date_trunc('day', stamp)"), ("dd-MMM-yy", "", "date_trunc('day', stamp)"),
    ("yyyyMMddHHmmss", "", "stamp"), ("yyyy-MM-dd HH.mm", "", "date_trunc('minute', stamp)"), ("yyyy-MM-dd'T'HH:mm:ss", "+05", "stamp - INTERVAL 5 HOUR"),
    ("yyyy-MM-dd HH:mm:ss", " EST", "stamp + INTERVAL 5 HOUR"), ("'on the' dd", "", "NULL"),
)
_STAMP_SQL = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 31536000))"


def _dated(spark, sf_dir):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stamp = F.timestamp_add("SECOND", (F.col("doc_id") * 7919 % 31_536_000).cast("int"), base)
    kind, text = F.col("doc_id") % len(LAYOUT_CASES), F.lit(None).cast("string")
    for i, (layout, suffix, _) in enumerate(LAYOUT_CASES):
        text = F.when(kind == i, F.concat(F.date_format(stamp, layout), F.lit(suffix))).otherwise(text)
    return V.table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("written"))


def date_layouts(spark, sf_dir):
    """The same instants in many layouts, the last of which is no date."""
    return _dated(spark, sf_dir).select("doc_id", parse_utc("written").alias("read"))


def unreadable_dates(spark, sf_dir):
    return N.unreadable_dates(_dated(spark, sf_dir), "written")


# Letters of the invented languages moved to Devanagari ones, and two words of the list put in.
LATIN, MOVED = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x0915 + i) for i in range(26))
GOOD, BAD = "मुनाफा", "गिरावट"


def devanagari_scores(spark, sf_dir):
    """Second-language scores of texts in Devanagari script."""
    text = F.concat(
        F.translate(F.lower("text"), LATIN, MOVED), F.repeat(F.lit(f" {GOOD}"), (F.col("doc_id") % 4).cast("int")),
        F.repeat(F.lit(f" {BAD}"), (F.col("doc_id") % 3).cast("int")))
    rows = V.table(spark, sf_dir, "documents").select("doc_id", text.alias("moved"), F.lit("hi").alias("language"))
    return scoring.score_by_language(rows, "moved", "language").select("doc_id", *[rounded(c).alias(c) for c in ("pos", "neg", "neu")])


def _workspace(spark, sf_dir, purpose: str, settings: Settings = Settings()) -> stages.Workspace:
    """A workspace whose price files are the daily bars, one file per ticker."""
    ws = stages.Workspace(spark, shared_folder(spark, purpose), settings)
    bars = materialize(V.bars(spark, sf_dir).withColumnRenamed("trade_date", "date"), "bars")
    for (ticker,) in bars.select("ticker").distinct().collect():  # a row per ticker
        bars.filter(F.col("ticker") == ticker).drop("ticker").write.parquet(ws.path("raw", "ohlcv", f"{ticker}.parquet"))
    return ws


def stage_partial_rebuild(spark, sf_dir):
    """Features of all tickers, then a run for one of them with forced rebuilding: the others' rows stay."""
    ws = _workspace(spark, sf_dir, "partial")
    stages.features(ws)
    one = dataclasses.replace(ws, settings=dataclasses.replace(ws.settings, tickers=("O",)), force=True, rebuilt=set())
    stages.features(one)
    stored = readers.read_by_ticker(spark, ws.path("stage", "features"))
    return stored.select("ticker", "trade_date", *[rounded(c).alias(c) for c in PRICE_FEATURES])


SHORT_DAYS = 20


def stage_empty(spark, sf_dir):
    """A ticker with too few days, then one without prices beside a whole one: stages give what there is."""
    ws = stages.Workspace(spark, shared_folder(spark, "empty"), Settings(tickers=("F",)))
    bars = V.bars(spark, sf_dir).withColumnRenamed("trade_date", "date")
    for ticker, own in (("F", bars.filter("ticker = 'F'").orderBy("date").limit(SHORT_DAYS)), ("O", bars.filter("ticker = 'O'"))):
        own.drop("ticker").write.parquet(ws.path("raw", "ohlcv", f"{ticker}.parquet"))
    short = stages.features(ws)
    samples = stages.fuse(ws)
    all_ = dataclasses.replace(ws, settings=dataclasses.replace(ws.settings, tickers=("F", "O", "Q")), rebuilt=set())
    rows = stages.features(all_)
    skipped = spark.read.json(ws.path("reports", "skipped_prices")).select(
        "ticker", F.lit(None).cast("date").alias("trade_date"), *[F.lit(None).cast("double").alias(c) for c in PRICE_FEATURES])
    own = [c for c in rows.columns if c in PRICE_FEATURES]
    built = rows.unionByName(short).select("ticker", "trade_date", *[rounded(c).alias(c) for c in own])
    return built.unionByName(samples.select("ticker", "trade_date", *[F.lit(-1.0).alias(c) for c in own])).unionByName(skipped)


def stage_changed_input(spark, sf_dir):
    """One price file is replaced by one without the newest days: only that ticker is rebuilt."""
    ws = _workspace(spark, sf_dir, "changed")
    stages.features(ws)
    before = ws.manifest.tickers("features")
    shorter = V.bars(spark, sf_dir, before=CHANGED_FROM).withColumnRenamed("trade_date", "date").filter("ticker = 'O'").drop("ticker")
    materialize(shorter, "shorter").write.mode("overwrite").parquet(ws.path("raw", "ohlcv", "O.parquet"))
    rows = stages.features(dataclasses.replace(ws, rebuilt=set()))
    after = ws.manifest.tickers("features")
    moved = [t for t in after if after[t]["completed_at"] != before[t]["completed_at"]]
    return rows.select("ticker", "trade_date", *[rounded(c).alias(c) for c in PRICE_FEATURES], F.col("ticker").isin(moved).alias("moved"))


CHANGED_FROM = "1999-01-01"


def stage_split_prices(spark, sf_dir):
    """One many-ticker price file is split, and the features stage reads the ticker partitions."""
    ws = stages.Workspace(spark, shared_folder(spark, "split"), Settings())
    suffix = F.when(F.col("ticker") == "P", ".BO").otherwise(".NS")
    master = V.bars(spark, sf_dir).select(
        F.concat("ticker", suffix).alias("Ticker"), F.col("trade_date").cast("string").alias("Date"), *[F.col(c).alias(c.title()) for c in N.BAR_COLUMNS])
    writers.write_csv(master, ws.path("raw", "all_prices"))
    stages.split_prices(ws, ws.path("raw", "all_prices"))
    return stages.features(ws).select("ticker", "trade_date", *[rounded(c).alias(c) for c in PRICE_FEATURES])


def unreadable_reports(spark, sf_dir):
    """Dates that no layout reads, counted by the merge, news and price steps."""
    ws = stages.Workspace(spark, shared_folder(spark, "reports"), Settings(tickers=("A0", "A1", "A2")))
    d = _dated(spark, sf_dir)
    ticker = F.concat(F.lit("A"), F.col("doc_id") % 3)
    text = F.concat(F.lit("report "), F.col("doc_id"))
    news = d.select(F.col("written").alias("datetime"), ticker.alias("ticker"), text.alias("headline"), "source", F.col("doc_id").cast("string").alias("url"))
    writers.write_csv(news, ws.path("inputs", "news.csv"))
    stages.merge_master(ws, [(ws.path("inputs", "news.csv"), "merged")])
    writers.write_csv(news, ws.path("raw", "news", readers.MASTER_NEWS))
    stages.sentiment(ws)
    day = F.when(F.col("doc_id") % len(LAYOUT_CASES) == len(LAYOUT_CASES) - 1, F.col("written")).otherwise(
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")).cast("string"))
    bars = d.select(ticker.alias("ticker"), day.alias("date"), *[F.lit(1.0).alias(c) for c in N.BAR_COLUMNS])
    for k in range(3):
        bars.filter(F.col("ticker") == f"A{k}").drop("ticker").write.parquet(ws.path("raw", "ohlcv", f"A{k}.parquet"))
    stages.features(ws)
    parts = [
        spark.read.json(ws.path("reports", f"unreadable_dates_{step}")).select(F.lit(step).alias("step"), F.col(by).alias("of"), "unreadable", "dated")
        for step, by in (("merge", "source_file"), ("news", "source"), ("prices", "ticker"))
    ]
    return N.union_by_name(parts)


def _logged(spark, sf_dir, ws: stages.Workspace, day: str) -> None:
    writers.write_prediction_log(V.prediction_log(spark, sf_dir), ws.path("logs", "predictions", f"{day}.json"))


def tier1_rerun(spark, sf_dir):
    """One day's trust update run twice: one version, one row per key."""
    ws = _trust_workspace(spark, sf_dir, "tier1")
    return spark.read.parquet(ws.path("weights")).select(F.col("version").cast("string").alias("version"), "key", rounded("weight", 4).alias("weight"))


def _trust_workspace(spark, sf_dir, purpose: str) -> stages.Workspace:
    settings = Settings(source_weights=V.TRUST, tickers=("F", "O", "P"))
    ws = stages.Workspace(spark, shared_folder(spark, purpose), settings)
    _logged(spark, sf_dir, ws, "2024-01-02")
    for _ in range(2):
        stages.tier1(ws, "2024-01-02")
    return ws


def sentiment_updated_weights(spark, sf_dir):
    """The sentiment stage weighs sources by the newest trust weights, and is rebuilt when they change."""
    settings = Settings(source_weights=V.TRUST, tickers=("F", "O", "P"))
    ws = stages.Workspace(spark, shared_folder(spark, "trust"), settings)
    ticker = F.element_at(F.array(*[F.lit(t) for t in settings.tickers]), (F.col("doc_id") % 3 + 1).cast("int"))
    word = F.when(F.col("doc_id") % 2 == 0, "profit").otherwise("loss")
    news = V.table(spark, sf_dir, "documents").select(
        F.date_format(F.timestamp_add("DAY", (F.col("doc_id") % 5).cast("int"), F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        ticker.alias("ticker"), F.concat_ws(" ", word, F.lit("report"), F.col("doc_id")).alias("headline"), "source",
        F.concat(F.lit("u"), F.col("doc_id")).alias("url"))
    writers.write_csv(news, ws.path("raw", "news", "all.csv"))
    stages.sentiment(ws)
    _logged(spark, sf_dir, ws, "2024-01-02")
    stages.tier1(ws, "2024-01-02")
    return stages.sentiment(ws).select("ticker", "trade_date", *[rounded(c).alias(c) for c in ("pos_1d", "neg_1d", "neu_1d")])


QUERIES = {
    f.__name__: f for f in (
        csv_master_roundtrip, date_layouts, unreadable_dates, devanagari_scores, stage_partial_rebuild, tier1_rerun,
        sentiment_updated_weights, stage_empty, stage_changed_input, stage_split_prices, unreadable_reports,
    )
}

_BAD = f"doc_id % {len(LAYOUT_CASES)} = {len(LAYOUT_CASES) - 1}"
_CASES = " ".join(f"WHEN {i} THEN {sql}" for i, (_, _, sql) in enumerate(LAYOUT_CASES))
_LOG_STEPS = "list_reduce(list_prepend({old}, steps), lambda w, a: round(least(greatest(0.95::DOUBLE * w + (1 - 0.95::DOUBLE) * a, 0.1::DOUBLE), 1.0::DOUBLE), 4))"
_KEYS = ", ".join(f"('{k}', {w}::DOUBLE, {i})" for i, (k, w) in enumerate(V.TRUST))
_FIRST_KEY = "(CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN '{k}'" for k, _ in V.TRUST) + " ELSE 'default' END)"
_WEIGHTS = f"""
    SELECT k.key, k.ord, coalesce({_LOG_STEPS.format(old='k.weight')}, k.weight) AS weight
    FROM (VALUES {_KEYS}) k(key, weight, ord) LEFT JOIN (
      SELECT key, list(accuracy ORDER BY first_seen, source) AS steps FROM (
        SELECT source, {_FIRST_KEY} AS key, min(row_id) AS first_seen, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
        FROM (SELECT row_id, coalesce(source, 'default') AS source, correct FROM prediction_log WHERE correct IS NOT NULL)
        GROUP BY 1, 2) GROUP BY 1) s USING (key)"""

ORACLES = {
    "csv_master_roundtrip": """
        SELECT doc_id, source, md5('"first"' || chr(10) || 'second ' || text) AS text_key FROM documents""",
    "date_layouts": f"""
        SELECT doc_id, CASE doc_id % {len(LAYOUT_CASES)} {_CASES} END AS "read" FROM (SELECT doc_id, {_STAMP_SQL} AS stamp FROM documents)""",
    "unreadable_dates": f"""
        SELECT source, count(*) FILTER (doc_id % {len(LAYOUT_CASES)} = {len(LAYOUT_CASES) - 1}) AS unreadable, count(*) AS dated
        FROM documents GROUP BY 1""",
    "devanagari_scores": f"""
        SELECT doc_id, {r6('good / (good + bad + 1)::DOUBLE')} AS pos, {r6('bad / (good + bad + 1)::DOUBLE')} AS neg,
               {r6('1 / (good + bad + 1)::DOUBLE')} AS neu
        FROM (SELECT doc_id, doc_id % 4 AS good, doc_id % 3 AS bad FROM documents)""",
    "stage_partial_rebuild": with_views("warm", f"SELECT ticker, trade_date, {r6_all(PRICE_FEATURES)} FROM warm"),
    "stage_empty": with_views("warm", f"""
        SELECT ticker, trade_date, {r6_all(PRICE_FEATURES)} FROM warm WHERE ticker = 'O'
        UNION ALL SELECT 'Q', NULL, {", ".join("NULL" for _ in PRICE_FEATURES)}"""),
    "stage_changed_input": with_views("warm", f"""
        SELECT ticker, trade_date, {r6_all(PRICE_FEATURES)}, ticker = 'O' AS moved FROM warm WHERE ticker <> 'O' OR trade_date < DATE '{CHANGED_FROM}'"""),
    "stage_split_prices": with_views("warm", f"SELECT ticker, trade_date, {r6_all(PRICE_FEATURES)} FROM warm"),
    "unreadable_reports": f"""
        SELECT 'merge' AS step, 'news.csv' AS of, count(*) FILTER ({_BAD}) AS unreadable, count(*) AS dated FROM documents
        UNION ALL SELECT 'news', source, count(*) FILTER ({_BAD}), count(*) FROM documents GROUP BY source
        UNION ALL SELECT 'prices', 'A' || (doc_id % 3), count(*) FILTER ({_BAD}), count(*) FROM documents GROUP BY doc_id % 3""",
    "tier1_rerun": with_views(
        "prediction_log", f"SELECT '2024-01-02' AS version, key, {r6('weight', 4)} AS weight FROM ({_WEIGHTS})"),
    "sentiment_updated_weights": with_views("prediction_log", f"""
        SELECT ticker, trade_date, {r6('sum(w * good) / sum(w)')} AS pos_1d, {r6('sum(w * bad) / sum(w)')} AS neg_1d, {r6('0.5')} AS neu_1d
        FROM (SELECT (['F', 'O', 'P'])[doc_id % 3 + 1] AS ticker, DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS trade_date,
                     CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS good, CASE WHEN doc_id % 2 = 1 THEN 0.5::DOUBLE ELSE 0 END AS bad,
                     weight AS w FROM documents d JOIN ({_WEIGHTS}) k ON k.key = {_FIRST_KEY.replace('source', 'd.source')})
        GROUP BY 1, 2"""),
}
