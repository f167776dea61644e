"""Date and time expressions: parsing, the market-close gate, calendar splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import MARKET_CLOSE_SECONDS, MARKET_ZONE
from .numeric import as_col

# Date layouts by the look of canonical text (see ``_canonical``); of two readings the day-first one wins.
DATES = (
    ("[0-9]{4}-[0-9]", ("yyyy-M-d",)), ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", ("d-M-yyyy", "M-d-yyyy")), ("[0-9]{8}", ("yyyyMMdd",)),
    ("[0-9]{1,2} [A-Za-z]", ("d MMM yyyy",)), ("[A-Za-z]", ("MMM d yyyy",)), ("[0-9]{4} [A-Za-z]", ("yyyy MMM d",)),
)
# Zone names that may stand at the end, with their offset in seconds. CST and the like are the American ones.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "IST": 19_800, "EST": -18_000, "EDT": -14_400, "CST": -21_600, "CDT": -18_000, "MST": -25_200, "MDT": -21_600,
    "PST": -28_800, "PDT": -25_200, "BST": 3_600, "CET": 3_600, "CEST": 7_200, "SGT": 28_800, "HKT": 28_800, "JST": 32_400,
}
# Zone written at the end: a name or an offset.
ZONE_SUFFIX = f"\\s*({'|'.join(ZONES)}|[+-][0-9]{{2}}(?::?[0-9]{{2}})?)$"
# Seconds or milliseconds since the epoch.
EPOCH = "^[0-9]{10}(?:[0-9]{3})?$"


def has_clock(text: Column | str) -> Column:
    return as_col(text).rlike("[0-9]{1,2}:[0-9]{2}|[0-9]\\s[0-9]{1,2}\\.[0-9]{2}")


def _canonical(text: Column | str) -> Column:
    """One spelling for what the layouts share: no weekday, zone or fraction; ``-`` between numbers, three-letter months."""
    bare = F.trim(as_col(text).cast("string"))
    # Only text with a clock part can carry an offset ("02-01-2024" must keep its year).
    clock = F.regexp_replace(F.regexp_replace(bare, ZONE_SUFFIX, ""), "(:[0-9]{2})[.,][0-9]+", "$1")
    out = F.when(has_clock(bare), clock).otherwise(bare)
    for pattern, new in (
        ("^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]?\\s+", ""), ("^([0-9]{8})T?([0-9]{2})([0-9]{2})([0-9]{2})$", "$1 $2:$3:$4"),
        ("^([0-9]{8})T?([0-9]{2})([0-9]{2})$", "$1 $2:$3"), ("(?<=[0-9]\\s)([0-9]{1,2})\\.([0-9]{2})(?:\\.([0-9]{2}))?$", "$1:$2:0$3"), (":0([0-9]{2})$", ":$1"), (":0$", ""), ("(?<=[0-9])T(?=[0-9])", " "), ("(?<=[0-9])[/.](?=[0-9])", "-"),
        ("(?<=[0-9])(st|nd|rd|th)\\b", ""), ("([A-Za-z]{3})[a-z]+", "$1"), ("(?<=[A-Za-z0-9])-(?=[A-Za-z])|(?<=[A-Za-z])-(?=[0-9])", " "),
        ("[,\\s]+", " "), ("^([0-9]{1,2}[- ](?:[0-9]{1,2}|[A-Za-z]{3})[- ])([0-6][0-9])(?![0-9:])", "$120$2"),
        ("^([0-9]{1,2}[- ](?:[0-9]{1,2}|[A-Za-z]{3})[- ])([7-9][0-9])(?![0-9:])", "$119$2"), ("(?i)\\s?([ap])\\.?m\\.?$", " $1M"),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def parse_naive(text: Column | str) -> Column:
    """Wall-clock timestamp without zone (of an epoch number in UTC); NULL where nothing fits.

    The look of the text picks its one or two layouts, so that few are tried.
    """
    # Read as UTC instants and counted from the zone-less epoch: the session's own
    # zone, with its skipped and repeated hours, plays no part.
    def instant(clean: Column) -> Column:
        utc, half_day, out = F.concat(clean, F.lit(" +0000")), clean.rlike("(?i) [ap]m$"), None
        for look, layouts in DATES:
            for clock, fits in ((" h:mm[:ss] a", half_day), ("[ H:mm[:ss]]", ~half_day)):
                read = F.coalesce(*[F.try_to_timestamp(utc, F.lit(f"{f}{clock} Z")) for f in layouts])
                here = clean.rlike("^" + look) & fits
                out = F.when(here, read) if out is None else out.when(here, read)
        return F.unix_seconds(out)

    # As the argument of a lambda the canonical text is worked out once, not once a branch.
    written = F.transform(F.array(_canonical(text)), instant)[0]
    bare = F.trim(as_col(text).cast("string"))
    number = F.when(F.length(bare) == 13, F.floor(bare.try_cast("long") / 1000)).otherwise(bare.try_cast("long"))
    seconds = F.when(bare.rlike(EPOCH), number).otherwise(written)
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def zone_offset_seconds(text: Column | str) -> Column:
    """Offset written at the end of the text, in seconds; NULL when there is none."""
    suffix = F.regexp_extract(F.trim(as_col(text)), ZONE_SUFFIX, 1)
    digits = F.regexp_replace(suffix, ":", "")
    sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    span = F.substring(digits, 2, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0)) * 60
    none = F.lit(None).cast("int")
    out = F.when(F.trim(as_col(text)).rlike(EPOCH), 0).when(~has_clock(text) | (suffix == ""), none)
    for seconds in sorted(set(ZONES.values())):
        out = out.when(suffix.isin([name for name, s in ZONES.items() if s == seconds]), seconds)
    return out.otherwise(sign * span)


def parse_utc(text: Column | str) -> Column:
    """UTC wall clock: a written offset is applied, text without one counts as UTC."""
    shift = F.coalesce(zone_offset_seconds(text), F.lit(0))
    return F.timestamp_add("SECOND", -shift, parse_naive(text))


def parse_market(text: Column | str) -> Column:
    """Market wall clock: offset-aware text is moved to the market zone, naive text is kept."""
    shift = zone_offset_seconds(text)
    naive = parse_naive(text)
    moved = F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), F.timestamp_add("SECOND", -shift, naive))
    return F.when(shift.isNull(), naive).otherwise(moved)


def seconds_of_day(ts: Column | str) -> Column:
    ts = as_col(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def gated_date(ts: Column | str, cutoff: int = MARKET_CLOSE_SECONDS) -> Column:
    """Trading date of an article: from the close on, it belongs to the next calendar day."""
    ts = as_col(ts)
    return F.date_add(F.to_date(ts), F.when(seconds_of_day(ts) >= cutoff, 1).otherwise(0))


def wall_date(text: Column | str) -> Column:
    """Day of the written wall clock; a zone suffix is ignored, not converted."""
    return F.to_date(parse_naive(as_col(text).cast("string")))


def split_name(day: Column | str, bounds: Sequence[tuple[str, str, str]]) -> Column:
    """Name of the first (name, start, end) range holding the day, ends included."""
    day = as_col(day)
    out: Column | None = None
    for name, start, end in bounds:
        hit = day.between(F.lit(dt.date.fromisoformat(start)), F.lit(dt.date.fromisoformat(end)))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def shift_months(day: dt.date, months: int) -> dt.date:
    """Calendar month arithmetic, clipped to the month's last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    first_next = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (first_next - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def rolling_retrain_bounds(as_of: dt.date, years: int = 3) -> dict[str, str]:
    """Training and validation dates of the monthly retrain."""
    half = shift_months(as_of, -6).isoformat()
    return {
        "train_start": shift_months(as_of, -12 * years).isoformat(),
        "train_end": half,
        "val_start": half,
        "val_end": shift_months(as_of, -3).isoformat(),
    }
