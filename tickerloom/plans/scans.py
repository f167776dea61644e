"""Queries that write one of the file layouts and scan it back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..functions.timing import parse_market
from ..operators import normalize as N, splits
from ..operators.news import published_column
from ..session import shared_folder
from ..settings import sentiment_columns
from ..sources import readers, writers
from . import views as V
from .lossless import _STAMP_SQL
from .sql import r6_all, split_case, with_views

HEADER = "Timestamp,Headline,Summary"


def _with_header(batches):
    """Each part file is a CSV file of its own."""
    first = True
    for batch in batches:
        if first:
            yield pa.RecordBatch.from_pydict({"line": [HEADER]}, schema=batch.schema)
        first = False
        yield batch


def strict_scan(spark, sf_dir):
    """Scraped files in which every tenth record has a field too many or too few, whole texts in quotes: only sound records stay."""
    path = shared_folder(spark, "scraped")
    kind = F.col("doc_id") % 10
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(kind == 3, F.concat_ws(",", "doc_id", F.lit("h"), quoted, F.lit("more"))).when(kind == 7, F.concat_ws(",", "doc_id", F.lit("h"))).otherwise(
        F.concat_ws(",", "doc_id", F.concat(F.lit("h "), F.col("source")), quoted))
    lines = V.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(line.alias("line"))
    lines.mapInArrow(_with_header, "line string").write.text(path)
    rows = N.scraped_headers(readers.read_csv(spark, path, strict=True))
    return rows.select(F.col("datetime").cast("long").alias("doc_id"), "headline", F.md5(F.coalesce("body", F.lit(""))).alias("body_key"))


def json_array_scan(spark, sf_dir):
    """Cases in JSON files of one array each, tickers in small letters, half of them without the optional fields."""
    path = shared_folder(spark, "cases")
    cases = V.cases(spark, sf_dir)
    files = cases.count() // 500 + 1
    fields = F.struct(
        F.lower("ticker").alias("ticker"), "news_input", F.when(F.col("case_id") % 2 == 0, F.col("case_id").cast("string")).alias("label"),
        F.when(F.col("case_id") % 2 == 0, F.col("expected_model_output")).alias("expected_model_output"))
    arrays = cases.groupBy(F.pmod(F.xxhash64("case_id"), F.lit(files)).alias("part")).agg(F.to_json(F.collect_list(fields)).alias("array"))
    arrays.write.partitionBy("part").text(path)
    return readers.read_cases(spark, path).select("ticker", F.md5("news_input").alias("news_key"), "label", "expected_model_output", "explanation")


def split_table_scan(spark, sf_dir):
    """Labelled days by split, of which only the validation part is read back."""
    path = shared_folder(spark, "splits")
    writers.write_split_tables(splits.assign_split(V.labelled_days(spark, sf_dir), V.SAMPLE_BOUNDS), path)
    return readers.read_split_table(spark, path, "val").select("ticker", "trade_date", "label", "split")


def sentiment_scan(spark, sf_dir):
    """Stored rolling sentiment whose day column is called ``date``."""
    path = shared_folder(spark, "sentiment")
    writers.write_by_ticker(V.rolling(spark, sf_dir).withColumnRenamed("trade_date", "date"), path, order="date")
    return readers.read_sentiment(spark, path).select("ticker", "trade_date", *[rounded(c).alias(c) for c in sentiment_columns()])


def date_and_time(spark, sf_dir):
    """Publication time from two columns; a missing time leaves the row without one."""
    stamp = F.timestamp_add("SECOND", (F.col("doc_id") * 7919 % 31_536_000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    d = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.date_format(stamp, "dd/MM/yyyy").alias("date"), F.when(F.col("doc_id") % 5 != 0, F.date_format(stamp, "HH:mm")).alias("time"))
    return d.select("doc_id", parse_market(published_column(d.columns)).alias("published"))


def shuffled(spark, sf_dir):
    """All documents in a seeded order, with the key that orders them."""
    d = V.table(spark, sf_dir, "documents").select("doc_id")
    return splits.seeded_shuffle(d, "doc_id", 7).select("doc_id", splits.hash_order("doc_id", 7).alias("order_key"))


QUERIES = {f.__name__: f for f in (strict_scan, json_array_scan, split_table_scan, sentiment_scan, date_and_time, shuffled)}

ORACLES = {
    "strict_scan": """
        SELECT doc_id, 'h ' || source AS headline, md5(text) AS body_key FROM documents WHERE text IS NOT NULL AND doc_id % 10 NOT IN (3, 7)""",
    "json_array_scan": with_views("cases", """
        SELECT upper(ticker) AS ticker, md5(news_input) AS news_key, CASE WHEN case_id % 2 = 0 THEN case_id::VARCHAR ELSE '' END AS label,
               CASE WHEN case_id % 2 = 0 THEN coalesce(expected_model_output, '') ELSE '' END AS expected_model_output, '' AS explanation FROM cases"""),
    "split_table_scan": with_views("samples", f"""
        SELECT ticker, trade_date, label, 'val' AS split FROM samples WHERE {split_case('trade_date', V.SAMPLE_BOUNDS)} = 'val'"""),
    "sentiment_scan": with_views("rolling", f"SELECT ticker, trade_date, {r6_all(sentiment_columns())} FROM rolling"),
    "date_and_time": f"""
        SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN date_trunc('minute', {_STAMP_SQL}) END AS published FROM documents""",
    "shuffled": "SELECT doc_id, md5(doc_id::VARCHAR || '-7') AS order_key FROM documents",
}
