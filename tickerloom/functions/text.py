"""String cleaning, keys, script detection and template filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col

# Everything Python's str.strip() removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
DEVANAGARI_GAP = "[^\\u0900-\\u097F]+"


def strip(x: Column | str) -> Column:
    """Outer white space removed; a scan from both ends, no regular expression over the text."""
    return F.btrim(as_col(x), F.lit(WHITESPACE))


def drop_breaks(x: Column | str) -> Column:
    """Newline -> space, carriage return removed."""
    return F.replace(F.replace(as_col(x), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def newline_to_space(x: Column | str) -> Column:
    """Newline -> space; carriage returns stay."""
    return F.replace(as_col(x), F.lit("\n"), F.lit(" "))


def tidy(x: Column | str) -> Column:
    """NULL -> empty, both line-break characters -> space, outer blanks stripped."""
    text = F.coalesce(as_col(x), F.lit(""))
    return strip(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def cut_then_clean(x: Column | str, limit: int = 500) -> Column:
    return drop_breaks(F.substring(as_col(x), 1, limit))


def clean_then_cut(x: Column | str, limit: int = 500) -> Column:
    """Differs from :func:`cut_then_clean` when the clean step deletes characters."""
    return F.substring(drop_breaks(x), 1, limit)


def upper_trim(x: Column | str) -> Column:
    return strip(F.upper(F.coalesce(as_col(x), F.lit(""))))


def blank_to(x: Column, default: str) -> Column:
    return F.when(x == "", F.lit(default)).otherwise(x)


def strip_suffixes(x: Column | str, suffixes: tuple[str, ...] = (".NS", ".BO")) -> Column:
    out = as_col(x)
    for suffix in suffixes:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return out


def article_key(url: Column | str | None, headline: Column | str | None) -> Column:
    """16 hex digits over url + headline.

    A column the table lacks (None) counts as empty text, a NULL cell as the
    text ``nan``.
    """
    parts = [F.lit("") if c is None else F.coalesce(as_col(c), F.lit("nan")) for c in (url, headline)]
    return F.substring(F.md5(F.concat(*parts)), 1, 16)


def devanagari_ratio(x: Column | str) -> Column:
    x = as_col(x)
    kept = F.length(F.regexp_replace(x, DEVANAGARI_GAP, ""))
    return kept / F.greatest(F.length(x), F.lit(1))


def language_label(x: Column | str, share: Column | str, threshold: float = 0.85) -> Column:
    """en / hi / hinglish / unknown from the text and its share of Devanagari characters."""
    share = as_col(share)
    return (
        F.when(strip(F.coalesce(as_col(x), F.lit(""))) == "", "unknown")
        .when((share > 0.05) & (share < 0.85), "hinglish")
        .when(share >= threshold, "hi")
        .when(share > 0.05, "hinglish")
        .otherwise("en")
    )


def detect_language(df: DataFrame, text: str, out: str, threshold: float = 0.85) -> DataFrame:
    """Language label column; the share is computed once per row."""
    shared = df.withColumn("_share", devanagari_ratio(F.coalesce(F.col(text), F.lit(""))))
    return shared.withColumn(out, language_label(text, "_share", threshold)).drop("_share")


def fill_template(template: Column | str, slots: dict[str, Column]) -> Column:
    out = as_col(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
