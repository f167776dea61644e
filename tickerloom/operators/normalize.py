"""Header rules, column mapping, row filters and by-name unions for news and price tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import last_pattern_tag, mentions_any
from ..functions.numeric import as_col
from ..functions.text import blank_to, clean_then_cut, cut_then_clean, drop_breaks, newline_to_space, strip, tidy, upper_trim
from ..functions.timing import parse_naive, parse_utc, wall_date

# --- fixed values: column names and mappings of the file layouts ---

MASTER_COLUMNS = (
    "datetime", "trade_date", "ticker", "headline", "body", "source", "source_type",
    "lang", "url", "company", "tags", "author", "source_file",
)
MERGED_COLUMNS = ("datetime", "ticker", "headline", "body", "source")
BAR_COLUMNS = ("open", "high", "low", "close", "volume")

# Old name -> new name, applied in order and only while the new name is free.
VARIANT_NAMES = (
    ("symbol", "ticker"),
    ("datepublished", "datetime"),
    ("timestamp", "datetime"),
    ("articlebody", "body"),
    ("summary", "body"),
    ("description", "body"),
)
SCRAPED_NAMES = {"timestamp": "datetime", "summary": "body"}

# --- end of fixed values ---


def snake_headers(df: DataFrame) -> DataFrame:
    """Strip, lower, blank -> underscore (news loader rule)."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def lower_headers(df: DataFrame) -> DataFrame:
    """Strip and lower only (price and ingest rule; inner blanks stay)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def scraped_headers(df: DataFrame) -> DataFrame:
    """Lower-cased headers with timestamp -> datetime and summary -> body."""
    return lower_headers(df).withColumnsRenamed(SCRAPED_NAMES)


def rename_exact(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Case-sensitive rename of the columns that are present."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def rename_variants(df: DataFrame, variants: Iterable[tuple[str, str]] = VARIANT_NAMES) -> DataFrame:
    names = list(df.columns)
    for old, new in variants:
        if old in names and new not in names:
            names[names.index(old)] = new
    return df.toDF(*names)


def reindex(df: DataFrame, columns: Sequence[str] = MASTER_COLUMNS) -> DataFrame:
    """Exactly these columns in this order; absent ones become NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def keep_present(df: DataFrame, columns: Sequence[str] = MERGED_COLUMNS) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add absent columns as constants; present columns keep their NULLs."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filter_tickers(df: DataFrame, tickers: Sequence[str] | None) -> DataFrame:
    """Rows of the given tickers, upper-cased.

    A table without a ticker column is matched by headline mentions instead; an
    article that mentions several tickers counts for each of them.
    """
    if not tickers:
        return df
    wanted = [t.upper() for t in tickers]
    if "ticker" in df.columns:
        return df.withColumn("ticker", F.upper("ticker")).filter(F.col("ticker").isin(wanted))
    if "headline" in df.columns:
        found = F.array_compact(F.array(*[F.when(mentions_any("headline", [t]), F.lit(t)) for t in wanted]))
        return df.withColumn("ticker", F.explode(found))
    return df


def tag_and_clean(
    df: DataFrame, source_name: str, patterns: Iterable[tuple[str, str]], body_limit: int | None = None,
) -> DataFrame:
    """Normalise one raw news table: headers, ticker tags, clean text, source name.

    Bodies are kept whole unless ``body_limit`` names a number of characters.
    """
    df = rename_variants(lower_headers(df))
    ticker = F.coalesce(F.col("ticker"), F.lit("")) if "ticker" in df.columns else F.lit("")
    columns: dict[str, Column] = {
        "ticker": F.when(ticker == "", last_pattern_tag("headline", patterns)).otherwise(ticker),
        "headline": newline_to_space("headline"),
        "source": F.lit(source_name),
    }
    if "body" in df.columns:
        body = newline_to_space("body")
        columns["body"] = body if body_limit is None else F.substring(body, 1, body_limit)
    return df.withColumns(columns)


def tagged_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ticker") != "")


def merge_tagged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tagged sources with a parsed, non-null datetime.

    Each row's text is tried against every known layout, so one odd first row
    does not turn the rest of a mixed column into NULL.
    """
    merged = union_by_name([keep_present(tagged_only(f)) for f in frames])
    return merged.withColumn("datetime", parse_naive("datetime")).na.drop(subset=["datetime"])


def unreadable_dates(df: DataFrame, column: str = "datetime", by: str = "source") -> DataFrame:
    """Rows per source whose date text no layout reads, next to all of its rows that have one."""
    written = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""
    return df.groupBy(by).agg(
        F.count_if(written & parse_naive(column).isNull()).alias("unreadable"), F.count_if(written).alias("dated"),
    )


def tag_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count_if(F.col("ticker") != "").alias("tagged"), F.count(F.lit(1)).alias("total")
    )


def clean_scraped(df: DataFrame, clean_first: bool = True, limit: int | None = None) -> DataFrame:
    """Scraped-file cleaning: header map, line breaks and, where ``limit`` is given, a body cut.

    ``clean_first`` chooses whether the cut happens after or before the line
    breaks are removed; the two tools of the pipeline differ in that.
    """
    df = scraped_headers(df)
    columns: dict[str, Column] = {}
    if "headline" in df.columns:
        columns["headline"] = drop_breaks("headline")
    if "body" in df.columns:
        if limit is None:
            columns["body"] = drop_breaks("body")
        else:
            columns["body"] = clean_then_cut("body", limit) if clean_first else cut_then_clean("body", limit)
    return df.withColumns(columns) if columns else df


def _text(df: DataFrame, name: str) -> Column:
    return tidy(F.col(name)) if name in df.columns else F.lit("")


def _ticker(df: DataFrame, name: str) -> Column:
    return upper_trim(F.col(name)) if name in df.columns else F.lit("")


def from_merged_file(df: DataFrame, file_name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Master rows from the ingest step's merged file."""
    when = parse_utc("datetime")
    return df.select(
        when.alias("datetime"), F.to_date(when).alias("trade_date"), _ticker(df, "ticker").alias("ticker"),
        *[_text(df, c).alias(c) for c in ("headline", "body", "source", "source_type")],
        blank_to(_text(df, "lang"), "unknown").alias("lang"), _text(df, "url").alias("url"),
        *[F.lit("").alias(c) for c in ("company", "tags", "author")],
        F.lit(file_name).alias("source_file"), *carry,
    )


def from_context_file(df: DataFrame, file_name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Master rows from a preprocessed context file (has its own trade_date)."""
    when = parse_utc("datetime")
    own_day = F.to_date(parse_utc("trade_date")) if "trade_date" in df.columns else F.lit(None).cast("date")
    return df.select(
        when.alias("datetime"), F.coalesce(own_day, F.to_date(when)).alias("trade_date"),
        _ticker(df, "ticker").alias("ticker"),
        *[_text(df, c).alias(c) for c in ("headline", "body", "source", "source_type")],
        blank_to(_text(df, "lang"), "unknown").alias("lang"),
        *[_text(df, c).alias(c) for c in ("url", "company", "tags")],
        F.lit("").alias("author"), blank_to(_text(df, "source_file"), file_name).alias("source_file"), *carry,
    )


def from_archive_file(df: DataFrame, file_name: str, carry: Sequence[str] = ()) -> DataFrame:
    """Master rows from the English archive layout (symbol, datePublished, articleBody, ...)."""
    when = parse_utc("datePublished") if "datePublished" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.select(
        when.alias("datetime"), F.to_date(when).alias("trade_date"), _ticker(df, "symbol").alias("ticker"),
        _text(df, "headline").alias("headline"), _text(df, "articleBody").alias("body"),
        F.lit("Moneycontrol").alias("source"), F.lit("archive").alias("source_type"), F.lit("en").alias("lang"),
        *[_text(df, c).alias(c) for c in ("url", "company", "tags", "author")],
        F.lit(file_name).alias("source_file"), *carry,
    )


LAYOUTS = {
    "merged": from_merged_file,
    "context": from_context_file,
    "archive": from_archive_file,
}


DATE_COLUMNS = {"merged": ("datetime",), "context": ("datetime",), "archive": ("datePublished",)}


def to_master(df: DataFrame, file_name: str, layout: str, carry: Sequence[str] = ()) -> DataFrame:
    """One input file in master schema; rows without datetime or headline are dropped.

    ``carry`` names extra columns to keep, such as the row's position in its file.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"Unsupported input layout for {file_name}: {layout}")
    rows = reindex(LAYOUTS[layout](df, file_name, carry), (*MASTER_COLUMNS, *carry))
    return rows.na.drop(subset=["datetime", "headline"]).filter(strip("headline") != "")


def master_dates(df: DataFrame, file_name: str, layout: str) -> DataFrame | None:
    """The written dates of one input file of :func:`to_master`, as ``source_file, datetime``; None without such a column."""
    column = next((c for c in DATE_COLUMNS[layout] if c in df.columns), None)
    return None if column is None else df.select(F.lit(file_name).alias("source_file"), F.col(column).cast("string").alias("datetime"))


def price_table(df: DataFrame) -> DataFrame:
    """Typed bars from a raw price table; missing columns are an error.

    The result has a ``ticker`` column when the input has one.
    """
    df = lower_headers(df)
    missing = {"date", *BAR_COLUMNS} - set(df.columns)
    if missing:
        raise ValueError(
            f"price table lacks columns {sorted(missing)}; found {sorted(df.columns)}"
        )
    keys = [F.col("ticker")] if "ticker" in df.columns else []
    return df.select(
        *keys, wall_date("date").alias("trade_date"), *[as_col(c).cast("double").alias(c) for c in BAR_COLUMNS]
    ).na.drop(subset=["trade_date"])


def unique_days(bars: DataFrame) -> DataFrame:
    """The bars, or an error at run time where a ticker has two for one day (windows count rows as days)."""
    keys = [c for c in ("ticker", "trade_date") if c in bars.columns]
    other = [c for c in bars.columns if c not in keys]
    name = F.concat_ws(" ", *[F.col(c).cast("string") for c in keys])
    counted = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in other])
    fault = F.raise_error(F.concat(F.lit("more than one bar for "), name)).cast("double")
    return counted.select(*[F.when(F.col("_n") > 1, fault).otherwise(F.col(c)).alias(c) if c == other[0] else F.col(c) for c in bars.columns])
