"""The views of ``views.py`` as SQL common table expressions."""

from __future__ import annotations

from ..settings import PRICE_FEATURES, sentiment_columns
from . import views as V

SENT = sentiment_columns()


def r6(expr: str, digits: int = 6) -> str:
    """Rounded value with -0.0 folded into 0.0, like ``numeric.rounded``."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


def r6_all(names, prefix: str = "") -> str:
    return ", ".join(f"{r6(prefix + n)} AS {n}" for n in names)


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def hits(values) -> str:
    return f"len(list_filter(toks, lambda w: w IN ({words(values)})))"


def weight_case(column: str, weights=V.TRUST) -> str:
    arms = " ".join(f"WHEN instr(lower({column}), '{k}') > 0 THEN {w}::DOUBLE" for k, w in weights)
    return f"(CASE {arms} ELSE {dict(weights).get('default', 0.5)}::DOUBLE END)"


def key_case(column: str, weights=V.TRUST) -> str:
    arms = " ".join(f"WHEN instr(lower({column}), '{k}') > 0 THEN '{k}'" for k, _ in weights)
    return f"(CASE {arms} ELSE 'default' END)"


def split_case(column: str, bounds) -> str:
    arms = " ".join(f"WHEN {column} BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in bounds)
    return f"(CASE {arms} END)"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    frame = f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} >= {least or n} THEN {fn}({x}) OVER {frame} END)"


W = "(PARTITION BY ticker ORDER BY trade_date)"


def zscore(x: str) -> str:
    return f"(({x} - {roll('avg', x, 50, 30)}) / ({roll('stddev_samp', x, 50, 30)} + 1e-9))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
        SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS trade_date,
               arg_min(px, o_orderkey) AS open, max(px) AS high, min(px) AS low,
               arg_max(px, o_orderkey) AS close, CAST(sum(o_custkey % 500 + 1) AS DOUBLE) AS volume
        FROM (SELECT *, 100 + o_totalprice / 50000.0::DOUBLE AS px FROM orders) GROUP BY 1, 2"""),
    "lagged": (("bars",), f"""
        SELECT *, lag(close) OVER {W} AS prev, ln(greatest(volume, 1.0)) AS log_vol FROM bars"""),
    "derived": (("lagged",), """
        SELECT *, CASE WHEN close / nullif(prev, 0) > 0 THEN ln(close / nullif(prev, 0)) END AS log_ret,
               CASE WHEN open / nullif(prev, 0) IS NOT NULL THEN ln(greatest(open / nullif(prev, 0), 1e-6)) END
                 AS gap_open,
               CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0.0) END AS gain,
               CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0.0) END AS loss,
               greatest(high - low, abs(high - prev), abs(low - prev)) AS tr
        FROM lagged"""),
    "rolled": (("derived",), f"""
        SELECT ticker, trade_date, close, log_ret, gap_open,
               volume / greatest({roll('avg', 'volume', 20)}, 1.0) AS vol_norm0, {roll('avg', 'volume', 20)} AS vmean,
               {roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + 1e-9) AS rs,
               close / {roll('avg', 'close', 10)} AS ma20_ratio,
               close / {roll('avg', 'close', 20)} AS ma50_ratio,
               close / {roll('avg', 'close', 50)} AS ma200_ratio,
               2 * {roll('stddev_samp', 'close', 20)} / ({roll('avg', 'close', 20)} + 1e-9) AS bb_width,
               {roll('avg', 'tr', 14)} AS atr,
               {zscore('log_vol')} AS vol_z, {zscore('log_ret')} AS log_ret_z
        FROM derived"""),
    "features": (("rolled",), """
        SELECT *, CASE WHEN vmean IS NOT NULL THEN vol_norm0 END AS vol_norm,
               (100 - 100 / (1 + rs)) / 100 AS rsi_14, atr / greatest(close, 1e-6) AS atr_14_norm FROM rolled"""),
    "warm": (("features",), "SELECT * FROM features WHERE "
             + " AND ".join(f"{c} IS NOT NULL" for c in PRICE_FEATURES)),
    "docs": ((), f"""
        SELECT doc_id, lang, source, url, substr(md5(coalesce(url, 'nan') || coalesce(text, 'nan')), 1, 16) AS row_hash,
               CASE WHEN lang = 'en' THEN {hits(V.ENGLISH_WORDS.positive)}
                    WHEN lang IN ({words(V.OTHER_LANGS)}) THEN {hits(V.OTHER_WORDS.positive)} ELSE 0 END AS good,
               CASE WHEN lang = 'en' THEN {hits(V.ENGLISH_WORDS.negative)}
                    WHEN lang IN ({words(V.OTHER_LANGS)}) THEN {hits(V.OTHER_WORDS.negative)} ELSE 0 END AS bad
        FROM (SELECT *, CASE WHEN doc_id % 10 <> 0 THEN source || '/' || n_chars END AS url,
                     string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}]+') AS toks FROM documents)"""),
    "docs_scored": (("docs",), """
        SELECT doc_id, lang, source, url, row_hash, good / (good + bad + 1)::DOUBLE AS pos,
               bad / (good + bad + 1)::DOUBLE AS neg, 1 / (good + bad + 1)::DOUBLE AS neu FROM docs"""),
    "placed": ((), """
        SELECT o_orderkey AS row_ord, o_orderstatus AS ticker,
               o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS pub_dt,
               o_orderkey % (SELECT count(*) FROM documents) AS doc_id FROM orders"""),
    "news": (("docs_scored", "placed"), """
        SELECT p.row_ord, p.ticker, p.pub_dt, d.*,
               CAST(p.pub_dt AS DATE) + CASE WHEN hour(p.pub_dt) * 3600 + minute(p.pub_dt) * 60 + second(p.pub_dt)
                                                  >= 55800 THEN 1 ELSE 0 END AS trade_date
        FROM placed p JOIN docs_scored d USING (doc_id)"""),
    "unique_news": (("news",), """
        SELECT * EXCLUDE (nth) FROM (
          SELECT *, row_number() OVER (PARTITION BY ticker, row_hash ORDER BY row_ord) AS nth FROM news)
        WHERE nth = 1"""),
}


def _daily(source: str) -> str:
    w = weight_case("source")
    en, hi = "lang = 'en'", f"lang IN ({words(V.OTHER_LANGS)})"
    parts = ", ".join(
        f"sum(CASE WHEN {mask} THEN w * {p} END) / nullif(sum(CASE WHEN {mask} THEN w END), 0) AS {tag}_{p}"
        for tag, mask in (("en", en), ("hi", hi)) for p in ("pos", "neg", "neu")
    )
    blend = ", ".join(
        f"(1 - hi_weight) * coalesce(en_{p}, {d}) + hi_weight * coalesce(hi_{p}, {d}) AS {p}"
        for p, d in (("pos", 0.0), ("neg", 0.0), ("neu", 1.0))
    )
    return f"""
        SELECT ticker, trade_date, {blend}, hi_count, hi_weight FROM (
          SELECT *, CASE WHEN hi_count < 3 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, hi_count / 6.0::DOUBLE) END
                 AS hi_weight
          FROM (SELECT ticker, trade_date, {parts}, count(*) FILTER ({hi}) AS hi_count
                FROM (SELECT *, {w} AS w FROM {source}) GROUP BY 1, 2))"""


def _rolling(source: str) -> str:
    cols = ", ".join(
        f"avg({p}) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        f" AS {p}_{n}d" for n in (1, 3, 7) for p in ("pos", "neg", "neu")
    )
    return f"SELECT ticker, trade_date, {cols} FROM {source}"


def _attached(source: str, covered: str) -> str:
    carried = ", ".join(
        f"CASE WHEN t.ticker IN (SELECT ticker FROM {covered}) THEN coalesce(last_value(r.{c} IGNORE NULLS) OVER "
        f"(PARTITION BY t.ticker ORDER BY t.trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0.0) "
        f"ELSE {1.0 if c.startswith('neu') else 0.0} END AS {c}" for c in SENT
    )
    return f"SELECT t.*, {carried} FROM warm t LEFT JOIN {source} r USING (ticker, trade_date)"


CTES["daily"] = (("news",), _daily("news"))
CTES["daily_unique"] = (("unique_news",), _daily("unique_news"))
CTES["rolling"] = (("daily",), _rolling("daily"))
CTES["rolling_unique"] = (("daily_unique",), _rolling("daily_unique"))
CTES["attached"] = (("warm", "rolling"), _attached("rolling", "rolling"))
CTES["rolling_part"] = (("rolling",), "SELECT * FROM rolling WHERE ticker <> 'P'")
CTES["attached_part"] = (("warm", "rolling_part"), _attached("rolling_part", "rolling_part"))
CTES["attached_unique"] = (("warm", "rolling_unique"), _attached("rolling_unique", "rolling_unique"))


def _positioned(source: str) -> str:
    return f"""
        SELECT *, CASE WHEN fwd_ret > 0.008 THEN 1.0::DOUBLE WHEN fwd_ret < -0.008 THEN 0.0::DOUBLE END AS label,
               greatest(5, 15 - CAST(trunc(atr_pct * 20) AS BIGINT)) AS "window"
        FROM (SELECT *, lead(close, 3) OVER {W} / close - 1 AS fwd_ret,
                     (rank() OVER (PARTITION BY ticker ORDER BY atr_14_norm)
                       + (count(*) OVER (PARTITION BY ticker, atr_14_norm) - 1) / 2.0::DOUBLE)
                       / (count(*) OVER (PARTITION BY ticker))::DOUBLE AS atr_pct,
                     row_number() OVER {W} - 1 AS pos_in_series, count(*) OVER (PARTITION BY ticker) AS n_rows
              FROM {source})"""


CTES["fused"] = (("attached",), _positioned("attached"))
CTES["fused_unique"] = (("attached_unique",), _positioned("attached_unique"))
CTES["samples"] = (("fused",), """
        SELECT * FROM fused WHERE pos_in_series >= 15 AND n_rows > 15 AND label IS NOT NULL""")
CTES["scored_days"] = (("samples",), """
        SELECT ticker, trade_date, label, "window", (dn * 7919 % 10007) / 10007.0::DOUBLE AS prob,
               (dn * 31 % 97) / 140.0::DOUBLE AS variance
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', trade_date) AS dn FROM samples)""")
CTES["eval_rows"] = ((), f"""
        SELECT event_id AS row_id, CAST(ts AS DATE) AS trade_date, event_type AS ticker,
               CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label,
               round((event_id * 7919 % 10007) / 10007.0::DOUBLE, 4) AS prob,
               round((event_id * 104729 % 997) / 9970.0::DOUBLE, 4) AS variance,
               {split_case('CAST(ts AS DATE)', V.EVENT_BOUNDS)} AS split FROM events""")
CTES["chosen"] = (("eval_rows",), "SELECT * FROM eval_rows WHERE split = 'test'")
CTES["judged"] = (("chosen",), """
        SELECT *, CASE WHEN pred = label THEN 1 ELSE 0 END AS correct FROM (
          SELECT *, CASE WHEN NOT abstained AND prob >= 0.5 THEN 1 ELSE 0 END AS pred,
                 CASE WHEN abstained THEN 'ABSTAIN' WHEN prob >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction
          FROM (SELECT *, variance > (SELECT avg(variance) + 1.5::DOUBLE * stddev_samp(variance) FROM chosen) AS abstained
                FROM chosen))""")
CTES["prediction_log"] = ((), """
        SELECT event_id AS row_id, CASE WHEN user_id % 20 <> 7 THEN 'SRC' || (user_id % 20) END AS source,
               CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 END AS correct FROM events""")
CTES["cases"] = ((), f"""
        SELECT conv_id * 1000 + turn AS case_id, ([{words(V.CASE_TICKERS)}])[conv_id % {len(V.CASE_TICKERS)} + 1] AS ticker,
               text AS news_input,
               ([{words(V.CASE_OUTPUTS)}])[(conv_id * 1000 + turn) % {len(V.CASE_OUTPUTS)} + 1] AS expected_model_output
        FROM conversations""")


def with_views(names: str, final: str) -> str:
    """``final`` preceded by the named views and all they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                add(dep)
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + final
