"""Sinks.  Writers never funnel a table through one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_suffixes
from ..operators.normalize import rename_exact

# --- fixed values: headers of the many-ticker price file ---
TITLE_NAMES = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
# --- end of fixed values ---


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts, quoted so that embedded quotes and line breaks survive."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def write_by_ticker(df: DataFrame, path: str, order: str = "trade_date", mode: str = "overwrite") -> None:
    """Parquet partitioned by ticker, sorted by date inside each file.

    ``overwrite`` replaces the tickers that ``df`` holds; others stay as they are.

    The range exchange on (ticker, date) cuts a dominant ticker into several
    date ranges, so its partition is written by several tasks.
    """
    df.repartitionByRange("ticker", order).sortWithinPartitions("ticker", order).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("ticker").parquet(path)


def split_master_prices(raw: DataFrame, path: str, suffixes: tuple[str, ...] = (".NS", ".BO")) -> None:
    """One partition per cleaned ticker from a many-ticker price table with a ``Ticker`` column."""
    table = rename_exact(raw, TITLE_NAMES).withColumn("ticker", F.upper(strip_suffixes("Ticker", suffixes)))
    columns = [c for c in table.columns if c.lower() != "ticker"]
    write_by_ticker(table.select("ticker", *columns), path, order="date")


def write_split_tables(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Samples partitioned by their split name."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON-lines folder per report section."""
    for name, table in tables.items():
        write_json_lines(table, f"{path}/{name}")


def write_weights(weights: DataFrame, path: str, version: str) -> None:
    """The trust weights of one version, replacing an earlier run of that version; other versions stay."""
    weights.write.mode("overwrite").parquet(f"{path}/version={version}")


def write_prediction_log(log: DataFrame, path: str) -> None:
    """A day's predictions as a folder of JSON lines; the stored ``row_id`` keeps their order."""
    log.select("row_id", "source", "correct").write.json(path)
