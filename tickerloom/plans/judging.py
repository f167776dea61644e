"""Queries over evaluation rows, calibration and epoch histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import evaluation as E
from ..session import materialize, shared_folder
from ..sources import writers
from . import views as V
from .sql import r6, r6_all, with_views

METRICS = (
    "accuracy", "up_precision", "up_recall", "up_f1", "down_precision", "down_recall", "down_f1", "macro_f1",
    "abstention_rate", "coverage",
)


def _chosen(spark, sf_dir):
    return E.select_split(V.eval_rows(spark, sf_dir), "test")


def _judged(spark, sf_dir):
    return E.judge(_chosen(spark, sf_dir))


def _judged_once(spark, sf_dir):
    """The narrow judged rows as a table: rows, pieces and days of the rolling accuracy all read it."""
    return materialize(_judged(spark, sf_dir).select("trade_date", "row_id", "abstained", "correct"), "judged")


def _r(*names):
    return [rounded(n).alias(n) for n in names]


def abstain_threshold(spark, sf_dir):
    """Per-row abstention and direction under mean + 1.5 std of the split's variance."""
    return _judged(spark, sf_dir).select("row_id", "abstained", "direction")


def eval_overall(spark, sf_dir):
    return E.overall(_judged(spark, sf_dir)).select("n_total", "n_active", *_r(*METRICS))


def eval_tiers(spark, sf_dir):
    return E.confidence_tiers(_chosen(spark, sf_dir)).select("sigma", "n", *_r("accuracy"))


def eval_per_ticker(spark, sf_dir):
    return E.per_ticker(_judged(spark, sf_dir)).select(
        "ticker", "n_active", *_r("accuracy", "macro_f1", "abstention_rate"))


# Section of the report -> (columns as stored, expression of the item, measures).
SECTIONS = {
    "overall": ("n_total long, " + ", ".join(f"{m} double" for m in METRICS), "'all'", METRICS),
    "confidence_tiers": ("sigma double, accuracy double", "CAST(CAST(round(sigma * 10) AS INT) AS STRING)", ("accuracy",)),
    "per_ticker": ("ticker string, accuracy double, macro_f1 double, abstention_rate double", "ticker", ("accuracy", "macro_f1", "abstention_rate")),
    "rolling_series": ("row_id long, accuracy double", "CAST(row_id AS STRING)", ("accuracy",)),
    "rolling_summary": ("rolling_min double, rolling_max double, rolling_mean double", "'all'", ("rolling_min", "rolling_max", "rolling_mean")),
    "reliability": ("bin_mid double, accuracy double", "CAST(CAST(round(bin_mid * 100) AS INT) AS STRING)", ("accuracy",)),
    "calibration": ("ece double", "'all'", ("ece",)),
    "confusion": ("tp double, fp double, tn double, fn double", "'all'", ("tp", "fp", "tn", "fn")),
}


def report_json(spark, sf_dir):
    """Every value of every section after the whole report went through its JSON sink."""
    path = shared_folder(spark, "report")
    writers.write_report(E.report_tables(V.eval_rows(spark, sf_dir), "test"), path)
    out = []
    for name, (schema, item, measures) in SECTIONS.items():
        rows = spark.read.schema(schema).json(f"{path}/{name}")
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), rounded(m, 9).alias("value")) for m in measures])
        out.append(rows.select(F.lit(name).alias("section"), F.expr(item).alias("item"), F.inline(pairs)))
    return reduce(DataFrame.union, out)


def _rolling(days):
    def query(spark, sf_dir):
        s = E.rolling_accuracy(_judged_once(spark, sf_dir), days, "row_id", block_bits=10)
        # twelve digits: shorter roundings meet exact decimal ties of n / 2^k here
        return s.select("trade_date", "row_id", rounded("accuracy", 12).alias("accuracy"))

    return query


def eval_rolling_summary(spark, sf_dir):
    s = E.rolling_accuracy(_judged_once(spark, sf_dir), 5, "row_id")
    return E.rolling_summary(s).select(*_r("rolling_min", "rolling_max", "rolling_mean"))


def ece(spark, sf_dir):
    return E.calibration_error(_judged(spark, sf_dir)).select(*_r("ece"))


def reliability(spark, sf_dir):
    return E.reliability(_judged(spark, sf_dir)).select(*_r("bin_mid", "mean_confidence", "accuracy"), "count")


def confusion(spark, sf_dir):
    return E.confusion(_judged(spark, sf_dir))


def _history(spark, sf_dir):
    """Daily evaluation means as a stand-in for a training history."""
    rows = V.eval_rows(spark, sf_dir)
    loss = -F.ln(F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob")) + 1e-6)
    hit = ((F.col("prob") >= 0.5).cast("int") == F.col("label"))
    return E.epoch_means(rows.select(F.dayofmonth("trade_date").alias("epoch"), loss.alias("loss"), hit.alias("correct")))


def epoch_means(spark, sf_dir):
    return _history(spark, sf_dir).select(F.col("epoch").cast("long").alias("epoch"), *_r("loss", "accuracy"))


def best_epoch(spark, sf_dir):
    h = _history(spark, sf_dir).withColumnRenamed("accuracy", "val_acc")
    return E.best_epoch(h).select(F.col("epoch").cast("long").alias("epoch"), *_r("val_acc"))


def lowest_loss_epoch(spark, sf_dir):
    return E.lowest_loss_epoch(_history(spark, sf_dir), "loss").select(F.col("epoch").cast("long").alias("epoch"), *_r("loss"))


QUERIES = {
    "abstain_threshold": abstain_threshold, "eval_overall": eval_overall, "eval_tiers": eval_tiers,
    "eval_per_ticker": eval_per_ticker, "eval_rolling30": _rolling(30), "eval_rolling5": _rolling(5),
    "eval_rolling_summary": eval_rolling_summary, "ece": ece, "reliability": reliability, "confusion": confusion,
    "report_json": report_json, "epoch_means": epoch_means, "best_epoch": best_epoch, "lowest_loss_epoch": lowest_loss_epoch,
}

_COUNTS = """
    count(*) AS n_total, count(*) FILTER (NOT abstained) AS n_active,
    count(*) FILTER (NOT abstained AND pred = 1 AND label = 1) AS tp,
    count(*) FILTER (NOT abstained AND pred = 1 AND label = 0) AS fp,
    count(*) FILTER (NOT abstained AND pred = 0 AND label = 0) AS tn,
    count(*) FILTER (NOT abstained AND pred = 0 AND label = 1) AS fn"""


def _metrics(group: str) -> str:
    keys = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""
        SELECT *, (up_f1 + down_f1) / 2 AS macro_f1, (tp + tn) / nullif(n_active, 0)::DOUBLE AS accuracy,
               1 - n_active / nullif(n_total, 0)::DOUBLE AS abstention_rate, n_active / nullif(n_total, 0)::DOUBLE AS coverage
        FROM (SELECT *, 2 * up_precision * up_recall / (up_precision + up_recall + 1e-9) AS up_f1,
                     2 * down_precision * down_recall / (down_precision + down_recall + 1e-9) AS down_f1
              FROM (SELECT *, tp / (tp + fp + 1e-9) AS up_precision, tp / (tp + fn + 1e-9) AS up_recall,
                           tn / (tn + fn + 1e-9) AS down_precision, tn / (tn + fp + 1e-9) AS down_recall
                    FROM (SELECT {keys}{_COUNTS} FROM judged{tail})))"""


def _rolling_sql(days: int) -> str:
    return f"""
        SELECT trade_date, row_id,
               (coalesce(sum(correct) OVER past, 0) + sum(correct) OVER today)
                 / (count(*) OVER past + count(*) OVER today)::DOUBLE AS accuracy
        FROM judged WHERE NOT abstained
        WINDOW past AS (ORDER BY trade_date RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING),
               today AS (PARTITION BY trade_date ORDER BY row_id ROWS UNBOUNDED PRECEDING)"""


_BINS = """
    SELECT i, i * 0.1::DOUBLE AS lo, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE (i + 1) * 0.1::DOUBLE END AS hi
    FROM (SELECT unnest(range(10)) AS i)"""
_REL = f"""
    SELECT (lo + hi) / 2 AS mid, avg(prob) AS mean_confidence, avg(label) AS accuracy, count(*) AS n
    FROM judged JOIN ({_BINS}) b ON prob >= lo AND prob < hi WHERE NOT abstained GROUP BY lo, hi"""
_HISTORY = """
    SELECT day(trade_date) AS epoch, avg(-ln(CASE WHEN label = 1 THEN prob ELSE 1 - prob END + 1e-6)) AS loss,
           avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
    FROM eval_rows GROUP BY 1"""

ORACLES = {
    "abstain_threshold": with_views("judged", "SELECT row_id, abstained, direction FROM judged"),
    "eval_overall": with_views("judged", f"SELECT n_total, n_active, {r6_all(METRICS)} FROM ({_metrics('')})"),
    "eval_tiers": with_views("chosen", f"""
        SELECT sigma, count(*) AS n, {r6('avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')}
               AS accuracy
        FROM chosen, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS sigma),
             (SELECT avg(variance) AS m, stddev_samp(variance) AS s FROM chosen)
        WHERE variance <= m + sigma * s GROUP BY 1"""),
    "eval_per_ticker": with_views("judged", f"""
        SELECT ticker, n_active, {r6_all(('accuracy', 'macro_f1', 'abstention_rate'))}
        FROM ({_metrics('ticker')}) WHERE n_active > 0"""),
    "eval_rolling30": with_views("judged", f"""
        SELECT trade_date, row_id, {r6('accuracy', 12)} AS accuracy FROM ({_rolling_sql(30)})"""),
    "eval_rolling5": with_views("judged", f"""
        SELECT trade_date, row_id, {r6('accuracy', 12)} AS accuracy FROM ({_rolling_sql(5)})"""),
    "eval_rolling_summary": with_views("judged", f"""
        SELECT {r6('min(accuracy)')} AS rolling_min, {r6('max(accuracy)')} AS rolling_max,
               {r6('avg(accuracy)')} AS rolling_mean FROM ({_rolling_sql(5)})"""),
    "ece": with_views("judged", f"""
        SELECT {r6('sum(n * abs(accuracy - mean_confidence)) / (SELECT count(*) FROM judged WHERE NOT abstained)')} AS ece
        FROM ({_REL})"""),
    "reliability": with_views("judged", f"""
        SELECT round(mid, 2) AS bin_mid, {r6_all(('mean_confidence', 'accuracy'))}, n AS count FROM ({_REL})"""),
    "confusion": with_views("judged", f"SELECT tp, fp, tn, fn FROM (SELECT {_COUNTS} FROM judged)"),
    "epoch_means": with_views("eval_rows", f"SELECT epoch, {r6_all(('loss', 'accuracy'))} FROM ({_HISTORY})"),
    "best_epoch": with_views("eval_rows", f"""
        SELECT epoch, {r6('accuracy')} AS val_acc FROM ({_HISTORY}) ORDER BY accuracy DESC, epoch LIMIT 1"""),
    "lowest_loss_epoch": with_views("eval_rows", f"""
        SELECT epoch, {r6('loss')} AS loss FROM ({_HISTORY}) AS h(epoch, l, accuracy), (SELECT 1)
        ORDER BY l, epoch LIMIT 1""".replace("round(loss", "round(l")),
}

_SECTION_SQL = {
    "overall": _metrics(""), "confidence_tiers": """
        SELECT sigma, avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
        FROM chosen, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS sigma),
             (SELECT avg(variance) AS m, stddev_samp(variance) AS s FROM chosen)
        WHERE variance <= m + sigma * s GROUP BY 1""",
    "per_ticker": f"SELECT * FROM ({_metrics('ticker')}) WHERE n_active > 0", "rolling_series": _rolling_sql(30),
    "rolling_summary": f"SELECT min(accuracy) AS rolling_min, max(accuracy) AS rolling_max, avg(accuracy) AS rolling_mean FROM ({_rolling_sql(30)})",
    "reliability": f"SELECT mid AS bin_mid, accuracy FROM ({_REL})",
    "calibration": f"SELECT sum(n * abs(accuracy - mean_confidence)) / (SELECT count(*) FROM judged WHERE NOT abstained) AS ece FROM ({_REL})",
    "confusion": f"SELECT tp, fp, tn, fn FROM (SELECT {_COUNTS} FROM judged)",
}
ORACLES["report_json"] = with_views("judged", " UNION ALL ".join(
    f"SELECT '{name}' AS section, {item} AS item, '{m}' AS measure, {r6(m, 9)} AS value FROM ({_SECTION_SQL[name]})"
    for name, (_, item, measures) in SECTIONS.items() for m in measures))
