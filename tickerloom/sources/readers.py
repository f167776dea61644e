"""File sources: news CSV, price files, JSON arrays, stage tables."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import price_table, snake_headers, union_by_name
from ..session import materialize
from . import quoted_csv

MASTER_NEWS = "final_news_master.csv"
FILE_ORDER, ROW_ORDER = "file_ord", "row_ord"


class Folder:
    """Driver-side view of one directory on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._new = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        self.path = path

    def names(self, suffix: str = "") -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return sorted(n for s in self._fs.listStatus(self._path) if (n := s.getPath().getName()).endswith(suffix))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._new(self._path, name))

    def is_folder(self, name: str) -> bool:
        return self.has(name) and self._fs.getFileStatus(self._new(self._path, name)).isDirectory()

    def modified(self, name: str) -> float:
        """Modification time in epoch seconds."""
        return self._fs.getFileStatus(self._new(self._path, name)).getModificationTime() / 1000.0

    def files(self, name: str) -> list[tuple[str, int, int]]:
        """Path, length and modification time of a file, or of all data files of a folder, by path."""
        if not self.has(name):
            return []
        found, more = [], self._fs.listFiles(self._new(self._path, name), True)
        while more.hasNext():
            s = more.next()
            if not s.getPath().getName().startswith(("_", ".")):
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)

    def join(self, name: str) -> str:
        return posixpath.join(self.path, name)

    def remove(self, name: str) -> None:
        self._fs.delete(self._new(self._path, name), True)

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._new(self._path, name), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        """One small file."""
        size = self._fs.getFileStatus(self._new(self._path, name)).getLen()
        came = self._fs.open(self._new(self._path, name))
        try:
            return bytes(b & 0xFF for b in came.readNBytes(size)).decode("utf-8")
        finally:
            came.close()

    def partition_files(self, column: str, value: str, table: str = "") -> list[tuple[str, int, int]]:
        """Files of one partition value of this table, or of one in this folder."""
        name = self._utils.getPartitionPathString(column, value)
        return self.files(posixpath.join(table, name) if table else name)

    def drop_partition(self, column: str, value: str) -> None:
        """Remove the folder of one partition value, if there."""
        name = self._utils.getPartitionPathString(column, value)
        self._fs.delete(self._new(self._path, name), True)


CSV_OPTIONS = {
    "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def _read_records(spark: SparkSession, path: str | Sequence[str], known: DataFrame, header: T.StructType, strict: bool) -> DataFrame:
    """Records cut from file ranges, with their places; the first record of a file is its header."""
    found = quoted_csv.records(spark, path, known).where(((F.col("start") > 0) | (F.col("n") > 0)) & (F.trim("record") != ""))
    bad = "_broken_record"
    schema = T.StructType([*header.fields, T.StructField(bad, T.StringType())])
    # A record is parsed by itself: no character of a text may end it, so that line ends in quotes stay as they are.
    row = F.from_csv("record", _ddl(schema), {**CSV_OPTIONS, "lineSep": "\uffff", "columnNameOfCorruptRecord": bad})
    place = F.struct("file", "start", "n").alias(ROW_ORDER)
    rows = found.select(row.alias("row"), place)
    return (rows.where(F.col(f"row.{bad}").isNull()) if strict else rows).select(*[F.col("row")[c].alias(c) for c in header.names], ROW_ORDER)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None, strict: bool = False, places: bool = False,
) -> DataFrame:
    """A CSV table with every column as text.

    ``strict`` drops rows whose field count differs from the header's. By default one pass over the files finds out where
    quoted line breaks lie: files without any are read as they are, others are cut into records range by range
    (``quoted_csv``). ``multi_line`` True reads each file in one piece, False takes every line for a record.
    ``places`` adds the column ``row_ord`` (file, range, number) by which rows can be put in order.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).options(**CSV_OPTIONS)
    if multi_line is None:
        known = materialize(quoted_csv.ranges(spark, path), "csv-states")
        many, broken = known.agg(F.count("*"), F.coalesce(F.bool_or(F.col("broken") | F.col("inside")), F.lit(False))).first()
        if broken and many <= quoted_csv.BROADCAST_RANGES:
            header = reader.option("multiLine", True).csv(path).schema  # the first record only: nothing is inferred from the rows
            rows = _read_records(spark, path, known, header, strict)
            return rows if places else rows.drop(ROW_ORDER)
        multi_line = broken
    reader = reader.option("multiLine", multi_line)
    if strict:
        header = reader.csv(path).schema
        reader = reader.schema(header).option("enforceSchema", True).option("mode", "DROPMALFORMED")
    rows = reader.csv(path)
    return rows.withColumn(ROW_ORDER, _place()) if places else rows


def _place():
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"),
    )


def with_row_order(df: DataFrame, file_ord: int) -> DataFrame:
    """Position columns: configured file number, then place within the file."""
    return df.withColumns({FILE_ORDER: F.lit(file_ord), **({} if ROW_ORDER in df.columns else {ROW_ORDER: _place()})})


def news_files(spark: SparkSession, folder: str, master: str = MASTER_NEWS, skip_prefix: str = "") -> list[str]:
    """The master file alone when present, else every CSV file in name order."""
    names = Folder(spark, folder).names(".csv")
    if master in names:
        return [master]
    return [n for n in names if not (skip_prefix and n.startswith(skip_prefix))]


def read_news(
    spark: SparkSession, folder: str, master: str = MASTER_NEWS, multi_line: bool | None = None, skip_prefix: str = "",
) -> DataFrame | None:
    """All news files of a folder unioned by column name, with row positions; None without files."""
    frames = []
    for i, name in enumerate(news_files(spark, folder, master, skip_prefix)):
        try:
            raw = read_csv(spark, posixpath.join(folder, name), multi_line, places=True)  # one rule, whatever the file's name
        except Exception as exc:  # an unreadable file is reported and left out
            print(f"[skip] {name}: {exc}")
            continue
        if set(raw.columns) - {ROW_ORDER}:
            frames.append(snake_headers(with_row_order(raw, i)))
    return union_by_name(frames) if frames else None


def price_candidates(ticker: str) -> tuple[str, ...]:
    return (f"{ticker}.parquet", f"{ticker.upper()}.parquet", f"{ticker}.csv", f"{ticker.upper()}.csv")


def price_file(have: Iterable[str], ticker: str) -> str | None:
    """The file of a ticker among the names of a folder: the first candidate that is there."""
    return next((c for c in price_candidates(ticker) if c in have), None)


def read_prices(spark: SparkSession, folder: str, tickers: Sequence[str]) -> DataFrame:
    """Bars of the tickers from one file per ticker, first existing candidate wins.

    A ticker without a file raises FileNotFoundError.
    """
    return union_by_name([price_table(raw) for raw in raw_prices(spark, folder, tickers)])


def raw_prices(spark: SparkSession, folder: str, tickers: Sequence[str]) -> list[DataFrame]:
    """The files of :func:`read_prices` as they are, with the ticker from the file name.

    Files of one format and header are one scan.
    """
    have = set(Folder(spark, folder).names())
    groups: dict[tuple[str, ...], list[str]] = {}
    for ticker in tickers:
        name = price_file(have, ticker)
        if name is None:
            raise FileNotFoundError(f"no price file for {ticker} in {folder}: expected one of {price_candidates(ticker)}")
        path = posixpath.join(folder, name)
        kind = name.rsplit(".", 1)[1]
        groups.setdefault((kind, *_open_prices(spark, kind, [path]).columns), []).append(path)
    stem = F.upper(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.(?:parquet|csv)(?:/[^/]*)?$", 1))
    frames = []
    for (kind, *columns), paths in groups.items():
        own = [c for c in columns if c.strip().lower() != "ticker"]
        frames.append(_open_prices(spark, kind, paths).select(*[F.col(f"`{c}`") for c in own], stem.alias("ticker")))
    return frames


def _open_prices(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths) if kind == "parquet" else read_csv(spark, paths)


def read_by_ticker(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table partitioned by ticker; all-digit tickers stay text. With a ``schema`` it may be without files."""
    schema = schema or spark.read.parquet(path).schema
    fixed = T.StructType([
        T.StructField("ticker", T.StringType()) if f.name == "ticker" else f for f in schema.fields
    ])
    return spark.read.schema(fixed).parquet(path)


def read_price_table(spark: SparkSession, path: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """Bars from one Parquet table partitioned by ticker (the layout for large universes), of all or only some of them."""
    rows = read_by_ticker(spark, path)
    return price_table(rows if tickers is None else rows.where(F.col("ticker").isin(list(tickers))))


def table_tickers(spark: SparkSession, path: str) -> list[str]:
    """Tickers of a table partitioned by ticker, from its folder names."""
    return sorted(unquote(n.split("=", 1)[1]) for n in Folder(spark, path).names() if n.startswith("ticker="))


def price_tickers(spark: SparkSession, folder: str, skip: Sequence[str] = ()) -> list[str]:
    """Tickers with a price file, from the file names."""
    names = Folder(spark, folder).names()
    stems = {n.rsplit(".", 1)[0] for n in names if n.endswith((".csv", ".parquet"))}
    return sorted({s.upper() for s in stems if s not in skip})


CASE_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "ticker", "news_input", "label", "expected_polarity", "expected_model_output", "explanation",
    )
])
LOG_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("correct", T.BooleanType())])


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Qualitative cases from a JSON array; absent optional fields become empty text."""
    raw = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in CASE_SCHEMA.names[2:]}
    return raw.withColumns({"ticker": F.upper("ticker"), **filled})


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Source and outcome records, in order of ``row_id``; a missing source means ``default``.

    A folder holds JSON lines with a ``row_id`` in part files, which are read in parallel; a file is one JSON array, whose
    positions are the ids.
    """
    parent, name = posixpath.split(path.rstrip("/"))
    if Folder(spark, parent).is_folder(name):
        rows = spark.read.schema(T.StructType([*LOG_SCHEMA.fields, T.StructField("row_id", T.LongType())])).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path).withColumn("row_id", F.monotonically_increasing_id())
    return rows.withColumn("source", F.coalesce("source", F.lit("default")))


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """Stored daily sentiment; a ``date`` column is accepted as the day."""
    df = read_by_ticker(spark, path)
    if "date" in df.columns:
        df = df.withColumnRenamed("date", "trade_date")
    return df.withColumn("trade_date", F.to_date("trade_date"))


#: Longest file whose content is read for a digest; beyond, length and time stand for it.
DIGEST_BYTES = 1 << 30


def file_digest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """md5 per file of a folder, glob or list, one task per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"))


def known_digests(spark: SparkSession, files: Sequence[tuple[str, int, int]], before: dict[str, list]) -> dict[str, list]:
    """Length, time and digest of each file; only files that are new or have changed length or time are read."""
    out = {p: before[p] if before.get(p, [])[:2] == [n, at] else [n, at, f"{n}@{at}"] for p, n, at in files}
    read = [p for p, n, _ in files if n <= DIGEST_BYTES and out[p] is not before.get(p)]
    if read:
        by_name = {p.split(":", 1)[-1].lstrip("/"): p for p in read}
        for r in file_digest(spark, read).select("path", "md5").collect():  # a row per changed input file
            out[by_name[r.path.split(":", 1)[-1].lstrip("/")]][2] = r.md5
    return out


def read_split_table(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of the samples written by ``write_split_tables``; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("split") == split)
