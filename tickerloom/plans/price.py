"""Queries over bars and price features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import price_features as pf
from ..settings import PRICE_FEATURES
from . import views as V
from .sql import r6, r6_all, with_views

SINCE = dt.date(2000, 1, 1)


# The plain range mean is a short decimal; eight digits keep it off rounding ties.
DIGITS = {"atr": 8}


def _feature_query(*names: str):
    def query(spark, sf_dir):
        cells = [rounded(n, DIGITS.get(n, 6)).alias(n) for n in names]
        return V.features(spark, sf_dir).select("ticker", "trade_date", *cells)

    return query


def _feature_sql(*names: str) -> str:
    cells = ", ".join(f"{r6(n, DIGITS.get(n, 6))} AS {n}" for n in names)
    return with_views("features", f"SELECT ticker, trade_date, {cells} FROM features")


def bars_daily(spark, sf_dir):
    cols = ("open", "high", "low", "close", "volume")
    return V.bars(spark, sf_dir).select("ticker", "trade_date", *[rounded(c).alias(c) for c in cols])


def volume_bars(spark, sf_dir):
    """Traded quantity per return flag, line status and day."""
    li = V.table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("trade_date")
    ).agg(rounded(F.sum("l_quantity"), 2).alias("volume"), F.count(F.lit(1)).alias("n_trades"))


def price_features(spark, sf_dir):
    cols = [rounded(c).alias(c) for c in (*PRICE_FEATURES, "close")]
    return V.warm(spark, sf_dir).select("ticker", "trade_date", *cols)


def features_since(spark, sf_dir):
    """Recent feature rows computed from only the bars their windows reach."""
    recent = pf.from_date(
        lambda first, before: V.bars(spark, sf_dir, first, before), lambda b: pf.price_features(b, V.FEATURES), SINCE, V.FEATURES.zscore_window + 1
    )
    return recent.select("ticker", "trade_date", *[rounded(c).alias(c) for c in PRICE_FEATURES])


def atr_pct_rank(spark, sf_dir):
    ranked = pf.with_atr_percentile(V.warm(spark, sf_dir))
    return ranked.select("ticker", "trade_date", rounded("atr_pct").alias("atr_pct"))


def dynamic_window(spark, sf_dir):
    ranked = pf.with_window_length(pf.with_atr_percentile(V.warm(spark, sf_dir)), V.FEATURES)
    return ranked.select("ticker", "trade_date", F.col("window").cast("long").alias("window"))


def ticker_catalog(spark, sf_dir):
    """Sorted distinct tickers of prices and news."""
    o = V.table(spark, sf_dir, "orders").select(F.upper("o_orderstatus").alias("ticker"))
    e = V.table(spark, sf_dir, "events").select(F.upper("event_type").alias("ticker"))
    return o.union(e).distinct().orderBy("ticker")


def relative_dates(spark, sf_dir):
    """Retrain window bounds relative to the newest bar: rows per window."""
    b = V.bars(spark, sf_dir)
    newest = b.agg(F.max("trade_date")).scalar()
    day = F.col("trade_date")
    part = (
        F.when(day.between(F.add_months(newest, -36), F.add_months(newest, -6)), "train")
        .when(day.between(F.add_months(newest, -6), F.add_months(newest, -3)), "val")
        .when(day == F.date_sub(newest, 1), "yesterday")
        .otherwise("outside")
    )
    return b.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


SINGLE = {
    "log_return": ("log_ret",), "gap_open": ("gap_open",), "rel_volume": ("vol_norm",), "rsi14": ("rsi_14",),
    "ma_ratio": ("ma20_ratio", "ma50_ratio", "ma200_ratio"), "bollinger_width": ("bb_width",),
    "atr14": ("atr", "atr_14_norm"), "zscore_returns": ("vol_z", "log_ret_z"),
}

QUERIES = {
    "bars_daily": bars_daily,
    "volume_bars": volume_bars,
    **{name: _feature_query(*cols) for name, cols in SINGLE.items()},
    "price_features": price_features,
    "features_since": features_since,
    "atr_pct_rank": atr_pct_rank,
    "dynamic_window": dynamic_window,
    "ticker_catalog": ticker_catalog,
    "relative_dates": relative_dates,
}

_RANKED = """
    SELECT ticker, trade_date,
           (rank() OVER (PARTITION BY ticker ORDER BY atr_14_norm)
             + (count(*) OVER (PARTITION BY ticker, atr_14_norm) - 1) / 2.0::DOUBLE)
             / (count(*) OVER (PARTITION BY ticker))::DOUBLE AS atr_pct FROM warm"""

ORACLES = {
    "bars_daily": with_views(
        "bars", f"SELECT ticker, trade_date, {r6_all(('open', 'high', 'low', 'close', 'volume'))} FROM bars"),
    "volume_bars": f"""
        SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
               {r6('sum(l_quantity)', 2)} AS volume, count(*) AS n_trades FROM lineitem GROUP BY 1, 2""",
    **{name: _feature_sql(*cols) for name, cols in SINGLE.items()},
    "price_features": with_views(
        "warm", f"SELECT ticker, trade_date, {r6_all((*PRICE_FEATURES, 'close'))} FROM warm"),
    "features_since": with_views(
        "features",
        f"SELECT ticker, trade_date, {r6_all(PRICE_FEATURES)} FROM features WHERE trade_date >= DATE '{SINCE}'"),
    "atr_pct_rank": with_views("warm", f"SELECT ticker, trade_date, {r6('atr_pct')} AS atr_pct FROM ({_RANKED})"),
    "dynamic_window": with_views("warm", f"""
        SELECT ticker, trade_date, greatest(5, 15 - CAST(trunc(atr_pct * 20) AS BIGINT)) AS "window" FROM ({_RANKED})"""),
    "ticker_catalog": """
        SELECT DISTINCT ticker FROM (SELECT upper(o_orderstatus) AS ticker FROM orders
                                     UNION ALL SELECT upper(event_type) FROM events) ORDER BY 1""",
    "relative_dates": with_views("bars", """
        SELECT CASE WHEN trade_date BETWEEN m - INTERVAL 36 MONTH AND m - INTERVAL 6 MONTH THEN 'train'
                    WHEN trade_date BETWEEN m - INTERVAL 6 MONTH AND m - INTERVAL 3 MONTH THEN 'val'
                    WHEN trade_date = m - 1 THEN 'yesterday' ELSE 'outside' END AS part, count(*) AS n
        FROM bars, (SELECT max(trade_date) AS m FROM bars) GROUP BY 1"""),
}
