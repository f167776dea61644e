"""Evaluation of directional predictions: abstention, accuracy, tiers, calibration, time.

Input rows carry ``trade_date, ticker, label, prob, variance, split``.
Thresholds that depend on the whole split are scalar subqueries, so every
report table is a plain aggregate over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import direction_or_abstain
from ..functions.numeric import ratio
from ..settings import EvaluationSettings

SMOOTH = 1e-9
DEFAULTS = EvaluationSettings()


def select_split(rows: DataFrame, split: str = "test") -> DataFrame:
    return rows.filter(F.col("split") == split)


def variance_bound(rows: DataFrame, sigma: float) -> Column:
    """mean + sigma * std of the split's variance, as a scalar subquery."""
    stats = rows.agg((F.avg("variance") + F.lit(sigma) * F.stddev_samp("variance")).alias("bound"))
    return stats.scalar()


def judge(rows: DataFrame, opts: EvaluationSettings = DEFAULTS) -> DataFrame:
    """Adds abstained, direction, pred and correct under the split's own threshold."""
    over = F.coalesce(F.col("variance") > variance_bound(rows, opts.abstain_sigma), F.lit(False))
    flagged = rows.withColumn("abstained", over)
    out = flagged.withColumn("direction", direction_or_abstain("prob", F.col("abstained")))
    return out.withColumn("pred", (F.col("direction") == "UP").cast("int")).withColumn(
        "correct", (F.col("pred") == F.col("label")).cast("int")
    )


def _counts(active: Column) -> list[Column]:
    up, down = F.col("pred") == 1, F.col("pred") == 0
    yes, no = F.col("label") == 1, F.col("label") == 0
    return [
        F.count_if(active & up & yes).alias("tp"), F.count_if(active & up & no).alias("fp"),
        F.count_if(active & down & no).alias("tn"), F.count_if(active & down & yes).alias("fn"),
        F.count_if(active).alias("n_active"), F.count(F.lit(1)).alias("n_total"),
    ]


def _prf(hit: str, false_hit: str, missed: str) -> tuple[Column, Column, Column]:
    tp, fp, fn = F.col(hit), F.col(false_hit), F.col(missed)
    p, r = tp / (tp + fp + SMOOTH), tp / (tp + fn + SMOOTH)
    return p, r, 2 * p * r / (p + r + SMOOTH)


def _with_metrics(counts: DataFrame) -> DataFrame:
    p_up, r_up, f_up = _prf("tp", "fp", "fn")
    p_dn, r_dn, f_dn = _prf("tn", "fn", "fp")
    return counts.withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), "n_active"),
        "up_precision": p_up, "up_recall": r_up, "up_f1": f_up,
        "down_precision": p_dn, "down_recall": r_dn, "down_f1": f_dn,
        "macro_f1": (f_up + f_dn) / 2,
        "abstention_rate": 1.0 - ratio("n_active", "n_total"),
        "coverage": ratio("n_active", "n_total"),
    })


def overall(judged: DataFrame) -> DataFrame:
    """One row: counts, accuracy, per-class metrics, abstention; none for an empty split."""
    return _with_metrics(judged.agg(*_counts(~F.col("abstained")))).filter(F.col("n_total") > 0)


def per_ticker(judged: DataFrame) -> DataFrame:
    """Tickers with at least one active row; abstention is over all their rows."""
    grouped = judged.groupBy("ticker").agg(*_counts(~F.col("abstained")))
    return _with_metrics(grouped).filter(F.col("n_active") > 0)


def confusion(judged: DataFrame) -> DataFrame:
    return judged.agg(*_counts(~F.col("abstained"))).select("tp", "fp", "tn", "fn")


def confidence_tiers(rows: DataFrame, opts: EvaluationSettings = DEFAULTS) -> DataFrame:
    """Accuracy among rows below mean + s * std of variance, one row per s, in one pass."""
    hit = (F.col("prob") >= 0.5).cast("int") == F.col("label")
    cells = []
    for i, sigma in enumerate(opts.tier_sigmas):
        inside = F.col("variance") <= variance_bound(rows, sigma)
        cells += [F.count_if(inside).alias(f"n{i}"), F.count_if(inside & hit).alias(f"k{i}")]
    wide = rows.agg(*cells)
    tiers = F.array(*[
        F.struct(F.lit(float(s)).alias("sigma"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("hits"))
        for i, s in enumerate(opts.tier_sigmas)
    ])
    return wide.select(F.inline(tiers)).select("sigma", "n", ratio("hits", "n").alias("accuracy"))


def bin_index(prob: Column, bins: int) -> Column:
    """Index of the half-open bin [k * step, (k + 1) * step) holding prob; ``bins`` for 1.0.

    The floor is corrected against the edges as floating point computes them,
    so values on an edge fall on the same side as in a comparison.
    """
    step = F.lit(1.0 / bins)
    k = F.floor(prob * bins)
    return F.when(prob < k * step, k - 1).when(prob >= (k + 1) * step, k + 1).otherwise(k)


def _binned(judged: DataFrame, bins: int) -> DataFrame:
    active = judged.filter(~F.col("abstained")).withColumn("bin", bin_index(F.col("prob"), bins))
    return active.groupBy("bin").agg(
        F.avg("prob").alias("mean_confidence"), F.avg("label").alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def reliability(judged: DataFrame, opts: EvaluationSettings = DEFAULTS) -> DataFrame:
    """Non-empty calibration bins; a probability of exactly 1 belongs to none."""
    bins = opts.calibration_bins
    mid = F.round((F.col("bin") + 0.5) / bins, 2)
    return _binned(judged, bins).filter(F.col("bin") < bins).select(
        mid.alias("bin_mid"), "mean_confidence", "accuracy", F.col("n").alias("count")
    )


def calibration_error(judged: DataFrame, opts: EvaluationSettings = DEFAULTS) -> DataFrame:
    """Expected calibration error: gaps weighted by bin share of all active rows."""
    bins = opts.calibration_bins
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return _binned(judged, bins).agg(
        ratio(F.sum(F.when(F.col("bin") < bins, gap).otherwise(0.0)), F.sum("n")).alias("ece")
    )


def rolling_accuracy(judged: DataFrame, days: int = 30, order: str = "row_id", block_bits: int = 20) -> DataFrame:
    """Accuracy over (t - days, t] ending at each active row, rows ordered by (date, order).

    ``order`` is a unique integer and breaks ties within a date.  A date can
    hold any share of the rows, so no window spans a date: rows are cut into
    (date, block of ``order`` values) pieces, running counts are taken inside a
    piece, and per-piece totals supply the offset.  A block spans
    2 ** block_bits consecutive values: 20 suits dense ids; hashed 64-bit ids
    want 48, which makes 65 536 even blocks per date.
    """
    active = judged.filter(~F.col("abstained")).select(
        "trade_date", F.col(order).alias("_ord"), "correct",
        F.shiftright(F.col(order).cast("long"), block_bits).alias("_block"),
    )
    pieces = active.groupBy("trade_date", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k")
    )
    earlier = Window.partitionBy("trade_date").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "trade_date", "_block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_bn"),
        F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_bk"),
    )
    # One row per calendar day: the only unpartitioned window, over a table that small.
    day_no = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    prior = Window.orderBy("_day").rangeBetween(-(days - 1), -1)
    by_day = pieces.groupBy("trade_date").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("_day", day_no)
    history = by_day.select(
        "trade_date",
        F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("_dn"),
        F.coalesce(F.sum("k").over(prior), F.lit(0)).alias("_dk"),
    )
    inside = Window.partitionBy("trade_date", "_block").orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = active.withColumns({
        "_n": F.count(F.lit(1)).over(inside), "_k": F.sum("correct").over(inside),
    })
    base = offsets.join(history, "trade_date")
    joined = placed.join(base, ["trade_date", "_block"])
    return joined.select(
        "trade_date", F.col("_ord").alias(order),
        ((F.col("_dk") + F.col("_bk") + F.col("_k")) / (F.col("_dn") + F.col("_bn") + F.col("_n"))).alias("accuracy"),
    )


def rolling_summary(series: DataFrame) -> DataFrame:
    return series.agg(
        F.min("accuracy").alias("rolling_min"), F.max("accuracy").alias("rolling_max"),
        F.avg("accuracy").alias("rolling_mean"),
    )


def report_tables(rows: DataFrame, split: str = "test", opts: EvaluationSettings = DEFAULTS,
                  order: str = "row_id", block_bits: int = 20) -> dict[str, DataFrame]:
    """Every section of the report as its own table."""
    chosen = select_split(rows, split)
    judged = judge(chosen, opts)
    series = rolling_accuracy(judged, opts.rolling_window_days, order, block_bits)
    return {
        "overall": overall(judged),
        "confidence_tiers": confidence_tiers(chosen, opts),
        "per_ticker": per_ticker(judged),
        "rolling_series": series,
        "rolling_summary": rolling_summary(series),
        "reliability": reliability(judged, opts),
        "calibration": calibration_error(judged, opts),
        "confusion": confusion(judged),
    }


def match_rate(results: DataFrame) -> DataFrame:
    """Share of cases whose output equals the expected one, among cases with an expectation."""
    flag = F.col("match_expected")
    return results.agg(
        F.count_if(flag).alias("matched"), F.count(flag).alias("total"),
    ).withColumn("match_rate", ratio("matched", "total"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch with the highest validation accuracy; the earliest one on a tie."""
    return history.agg(F.max_by("epoch", F.struct("val_acc", -F.col("epoch"))).alias("epoch"),
                       F.max("val_acc").alias("val_acc"))


def lowest_loss_epoch(history: DataFrame, loss: str = "train_loss") -> DataFrame:
    return history.agg(F.min_by("epoch", F.struct(F.col(loss), F.col("epoch"))).alias("epoch"),
                       F.min(loss).alias("loss"))


def epoch_means(rows: DataFrame) -> DataFrame:
    """Sample-weighted loss and accuracy per epoch from per-sample losses."""
    return rows.groupBy("epoch").agg(
        F.avg("loss").alias("loss"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )
