"""Queries that pass through files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import normalize as N
from ..operators.dedup import dedup_articles
from ..operators.sentiment import blend_classes, class_means
from ..session import materialize, shared_folder
from ..settings import sentiment_columns
from ..sources import readers, writers
from ..streaming import daily as S
from . import views as V
from .sql import _daily, r6, r6_all, with_views


def csv_news_roundtrip(spark, sf_dir):
    """Whole texts with quotes and line breaks written as CSV, scanned back and de-duplicated."""
    path = shared_folder(spark, "news-csv")
    d = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("Doc Id"), F.upper("lang").alias(" Ticker"),
        F.concat(F.lit('He said "now", then\n'), F.col("text")).alias("Headline "),
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("URL"),
    )
    writers.write_csv(d, path)
    back = N.snake_headers(readers.read_csv(spark, path))
    rows = dedup_articles(back.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    return rows.select("ticker", "row_hash", "doc_id", F.length("headline").cast("long").alias("n_chars"))


def split_by_ticker(spark, sf_dir):
    """Many-ticker price table split into ticker partitions and read back."""
    path = shared_folder(spark, "prices")
    b = V.bars(spark, sf_dir)
    suffix = F.when(F.col("ticker") == "P", ".BO").otherwise(".NS")
    master = b.select(
        F.concat("ticker", suffix).alias("Ticker"), F.col("trade_date").cast("string").alias("Date"),
        *[F.col(c).alias(c.title()) for c in N.BAR_COLUMNS])
    writers.split_master_prices(master, path)
    back = readers.read_price_table(spark, path)
    return back.select("ticker", "trade_date", *[rounded(c).alias(c) for c in N.BAR_COLUMNS])


def _stream_articles(spark, sf_dir, orders):
    """A stream of orders as articles, joined with a table of text scores that was computed once."""
    scored = materialize(V.documents_scored(spark, sf_dir), "scored-texts")
    n_docs = V.table(spark, sf_dir, "documents").count()  # fixed for the life of the stream
    epoch_day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    seconds = epoch_day.cast("long") * 86400 + F.col("o_orderkey") * 7919 % 86400
    return orders.select(
        F.col("o_orderstatus").alias("ticker"), (F.col("o_orderkey") % n_docs).alias("doc_id"),
        F.timestamp_seconds(seconds).alias("pub_dt"),
    ).join(scored, "doc_id")


def _stream_result(state):
    return blend_classes(state).select(
        "ticker", "trade_date", *[rounded(p).alias(p) for p in ("pos", "neg", "neu")], "hi_count",
        rounded("hi_weight").alias("hi_weight"))


def stream_daily_sentiment(spark, sf_dir):
    """Daily sentiment of order-time articles computed as a stream over the available files."""
    schema = V.table(spark, sf_dir, "orders").schema
    # a glob serves both layouts of the table, one file or a folder of parts
    orders = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/[o]rders.parquet")
    work = shared_folder(spark, "stream")
    S.add_by_batch(
        _stream_articles(spark, sf_dir, orders), f"{work}/rows", f"{work}/state", other_langs=V.OTHER_LANGS, weights=V.TRUST,
    ).awaitTermination()
    return _stream_result(S.summed(spark, f"{work}/rows"))


def stream_backfill(spark, sf_dir):
    """The newer half of the days streamed first, the older half in a second run: both must count."""
    work = shared_folder(spark, "backfill")
    orders = V.table(spark, sf_dir, "orders")
    middle = orders.agg(F.percentile_approx(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), 0.5)).first()[0]
    newer = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) >= middle
    for part in (newer, ~newer):
        orders.filter(part).write.mode("append").parquet(f"{work}/in")
        arriving = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 4).parquet(f"{work}/in")
        S.add_by_batch(
            _stream_articles(spark, sf_dir, arriving), f"{work}/rows", f"{work}/state", other_langs=V.OTHER_LANGS, weights=V.TRUST,
        ).awaitTermination()
        S.compact(spark, f"{work}/rows")
    return _stream_result(S.summed(spark, f"{work}/rows"))


def stream_rolling_sentiment(spark, sf_dir):
    """Rolling sentiment kept by a stream: day sums of all even orders first, then of the odd ones, which come late for their days."""
    work = shared_folder(spark, "rolling")
    orders = V.table(spark, sf_dir, "orders")
    articles = _stream_articles(spark, sf_dir, orders)
    timed = S.with_gate_time(articles).withColumn("trade_date", S.gate_day(S.GATE_TIME))
    for rest in (0, 1):
        part = class_means(timed.filter(F.col("doc_id") % 2 == rest), other_langs=V.OTHER_LANGS, weights=V.TRUST)
        part.select("ticker", "trade_date", *[F.col(c).cast("double").alias(c) for c in S.SUMS]).write.mode("append").parquet(f"{work}/in")
        schema = spark.read.parquet(f"{work}/in").schema
        arriving = spark.readStream.schema(schema).parquet(f"{work}/in")
        S.upsert_by_batch(S.rolling_by_ticker(arriving), f"{work}/out", f"{work}/state", "append").awaitTermination()
    newest = S.latest_state(spark.read.parquet(f"{work}/out"), ["ticker", "trade_date"])
    return newest.select("ticker", "trade_date", *[rounded(c).alias(c) for c in sentiment_columns()])


QUERIES = {f.__name__: f for f in (csv_news_roundtrip, split_by_ticker, stream_daily_sentiment, stream_backfill, stream_rolling_sentiment)}

ORACLES = {
    "csv_news_roundtrip": """
        SELECT ticker, row_hash, doc_id, n_chars FROM (
          SELECT upper(lang) AS ticker, doc_id, length(h) AS n_chars,
                 substr(md5(CASE WHEN doc_id % 10 <> 0 THEN source ELSE 'nan' END || h), 1, 16) AS row_hash
          FROM (SELECT *, 'He said "now", then' || chr(10) || text AS h FROM documents))
        QUALIFY row_number() OVER (PARTITION BY ticker, row_hash ORDER BY doc_id) = 1""",
    "split_by_ticker": with_views(
        "bars", f"SELECT ticker, trade_date, {r6_all(N.BAR_COLUMNS)} FROM bars"),
    "stream_daily_sentiment": with_views(
        "news", f"SELECT ticker, trade_date, {r6_all(('pos', 'neg', 'neu'))}, hi_count, {r6('hi_weight')} AS hi_weight "
        f"FROM ({_daily('news')})"),
}
ORACLES["stream_backfill"] = ORACLES["stream_daily_sentiment"]
ORACLES["stream_rolling_sentiment"] = with_views("rolling", f"SELECT ticker, trade_date, {r6_all(sentiment_columns())} FROM rolling")
