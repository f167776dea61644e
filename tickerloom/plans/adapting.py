"""Queries over trust updates, weight consolidation, predictions and cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions.numeric import rounded
from ..operators import adaptive as A, direction_model as M, evaluation as E, predict as P, scoring, sequences, splits
from ..session import materialize
from ..settings import ModelSettings, TrainingSettings
from . import views as V
from .sql import key_case, r6, r6_all, with_views

PASSES = 30


def _r(*names):
    return [rounded(n).alias(n) for n in names]


def tier1_source_accuracy(spark, sf_dir):
    acc = A.source_accuracy(V.prediction_log(spark, sf_dir), "row_id")
    return acc.select("source", "n", "first_seen", *_r("accuracy"))


def tier1_ema(spark, sf_dir):
    acc = A.source_accuracy(V.prediction_log(spark, sf_dir), "row_id")
    return A.update_weights(acc, V.TRUST).select(
        "key", "old_weight", *_r("new_weight"), F.col("n_sources").cast("long").alias("n_sources"))


def _logistic_rows(spark, sf_dir):
    rows = V.eval_rows(spark, sf_dir)
    return rows.withColumns({
        "batch": F.col("row_id") % 50, "x1": F.col("variance") * 10, "x2": F.col("prob") - 0.5, "bias": F.lit(1.0),
    })


def fisher_diagonal(spark, sf_dir):
    names = ("x1", "x2", "bias")
    rows = _logistic_rows(spark, sf_dir).withColumn("features", F.array(*names))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") + 1)
    return A.fisher_diagonal(rows).select(name.alias("name"), *_r("fisher"))


NUDGE = {"weights": (0.8, -1.5), "bias": 0.1, "fisher": (0.004, 0.006, 0.009), "rate": 0.4, "clip": 0.05}


def ewc_nudge_step(spark, sf_dir):
    """Two anchored steps of a logistic model with two inputs and a bias, without and with the penalty."""
    rows = materialize(_logistic_rows(spark, sf_dir).select(F.array("x1", "x2").alias("features"), "label"), "nudge")
    start = M.DirectionModel(NUDGE["weights"], NUDGE["bias"])
    out = []
    for strength in (0.0, 400.0):
        model = M.ewc_nudge(rows, start, np.array(NUDGE["fisher"]), strength, NUDGE["rate"], 2, NUDGE["clip"])
        out += [(strength, n, float(w)) for n, w in zip(("x1", "x2", "bias"), (*model.weights, model.bias))]
    return spark.createDataFrame(out, "strength double, name string, theta double").select("strength", "name", *_r("theta"))


def ewc_penalty(spark, sf_dir):
    """Penalty over a parameter table aggregated from line items."""
    params = V.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("idx")
    ).agg(F.avg("l_discount").alias("theta"), F.avg("l_tax").alias("theta_ref"), (F.avg("l_quantity") / 50).alias("fisher"))
    return A.ewc_penalty(params).select(*_r("penalty"))


def mc_mean_var(spark, sf_dir):
    """Mean and variance over seeded passes, fixed abstention and confidence scores."""
    rows = V.eval_rows(spark, sf_dir)

    def one_pass(i):
        noise = (F.col("row_id") * 31 + i * 7919) % 10007 / 10007.0 - 0.5
        return D.sigmoid((F.col("prob") - 0.5) * 4 + noise * 8)

    out = P.monte_carlo(rows.select("row_id", "prob"), ["row_id"], one_pass, PASSES, "mc_prob", "mc_var")
    return out.select(
        "row_id", *_r("mc_prob", "mc_var"),
        D.direction_or_abstain("mc_prob", D.fixed_abstain("mc_var", 0.93)).alias("direction"),
        rounded(D.confidence("mc_prob", "mc_var")).alias("confidence"),
    )


def predict_latest(spark, sf_dir):
    return P.latest_predictions(V.scored_days(spark, sf_dir))


def polarity_map(spark, sf_dir):
    d = V.documents_scored(spark, sf_dir)
    conf = F.abs(F.col("pos") - F.col("neg"))
    call = F.when(F.col("doc_id") % 9 == 0, "ABSTAIN").otherwise(D.direction(0.5 + (F.col("pos") - F.col("neg")) / 2))
    return d.select(
        "doc_id", D.polarity("pos", "neg").alias("polarity"),
        D.reported_output(call, conf).alias("output"),
    )


def temperature_softmax(spark, sf_dir):
    d = V.documents_scored(spark, sf_dir)
    soft = D.temper([F.col("pos"), F.col("neg"), F.col("neu")], 4.0)
    return d.select("doc_id", *[rounded(s).alias(n) for s, n in zip(soft, ("pos", "neg", "neu"))])


def distill_loss(spark, sf_dir):
    """Mean distillation loss per language over every document."""
    d = V.documents_scored(spark, sf_dir)
    soft = D.temper([F.col("pos"), F.col("neg"), F.col("neu")], 4.0)
    logits = [F.col("pos") * 3, F.col("neg") * 2, F.col("neu")]
    loss = D.distillation_loss(logits, soft, F.col("doc_id") % 3)
    return d.groupBy("lang").agg(rounded(F.avg(loss)).alias("loss"))


def _price_tickers(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ticker"))


def supported_cases_semi(spark, sf_dir):
    kept = P.supported_cases(V.cases(spark, sf_dir), _price_tickers(spark, sf_dir))
    return kept.select("case_id", "ticker", F.md5("news_input").alias("news_key"), "expected_model_output")


def dropped_anti(spark, sf_dir):
    return P.dropped_tickers(V.cases(spark, sf_dir), _price_tickers(spark, sf_dir))


def _judged_cases(spark, sf_dir):
    """Cases with language, scores, the ticker's latest sequence window and a decision.

    Probability and variance are arithmetic stand-ins for the model's.
    """
    cases = V.case_language(P.supported_cases(V.cases(spark, sf_dir), _price_tickers(spark, sf_dir)))
    scored = scoring.score_by_language(cases, "news_input", "language", V.ENGLISH_WORDS, V.ENGLISH_WORDS)
    latest = sequences.latest_sequence(V.fused(spark, sf_dir), V.FEATURES).select(
        "ticker", F.col("trade_date").alias("latest_price_date_used"), F.col("window").cast("long").alias("effective_window"))
    with_price = scored.join(latest, "ticker").withColumns({
        "prob": (F.col("case_id") * 7919 % 10007) / 10007.0, "variance": (F.col("case_id") * 31 % 97) / 200.0,
    })
    return P.judge_cases(with_price)


def qualitative_cases(spark, sf_dir):
    return _judged_cases(spark, sf_dir).select(
        "case_id", "ticker", "language", "sentiment_polarity", *_r("pos", "neg", "neu", "net_sentiment"),
        "expected_model_output", "actual_model_output", "match_expected", F.col("direction").alias("raw_direction"),
        *_r("prob_up", "variance", "confidence"), "latest_price_date_used", "effective_window",
    )


def match_rate(spark, sf_dir):
    return E.match_rate(_judged_cases(spark, sf_dir)).select("matched", "total", *_r("match_rate"))


_MODELS: dict[tuple[str, str], M.DirectionModel] = {}


def _model_samples(spark, sf_dir):
    samples = splits.assign_split(sequences.flat_features(V.samples(spark, sf_dir)), V.SAMPLE_BOUNDS)
    return samples.select("ticker", "trade_date", "label", "split", "features")


def _fitted(spark, sf_dir, samples=None) -> M.DirectionModel:
    """The default model of the train split, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        rows = _model_samples(spark, sf_dir) if samples is None else samples
        _MODELS[key] = M.fit(materialize(rows.filter("split = 'train'").select("label", "split", "features"), "train-samples"), TrainingSettings())
    return _MODELS[key]


def model_fit_score(spark, sf_dir):
    """Default model fitted on the train split, dropout scores on the validation and test splits, overall metrics of each."""
    samples = materialize(_model_samples(spark, sf_dir), "samples")
    model = _fitted(spark, sf_dir, samples)
    scored = materialize(M.mc_scores(samples.filter("split <> 'train'"), model, ModelSettings()).drop("features"), "scored")
    parts = [
        E.overall(E.judge(scored.filter(F.col("split") == name))).select(F.lit(name).alias("split"), "n_total", "n_active", *_r("accuracy", "macro_f1", "coverage"))
        for name in ("val", "test")
    ]
    return parts[0].unionByName(parts[1])


def model_predictions(spark, sf_dir):
    """The newest labelled sample of each ticker, judged by the fitted model's dropout passes."""
    rows = _model_samples(spark, sf_dir)
    counts = rows.groupBy("ticker").agg(F.count("*").alias("n_samples"))
    newest = sequences.latest_samples(rows.select("ticker", "trade_date", "label", "features")).join(counts, "ticker")
    return P.judge_latest(M.mc_scores(newest, _fitted(spark, sf_dir), ModelSettings(), digits=12))


def model_cases(spark, sf_dir):
    """Cases judged by the fitted model on each ticker's latest sequence, with the case's scores as its sentiment."""
    cases = V.case_language(P.supported_cases(V.cases(spark, sf_dir), _price_tickers(spark, sf_dir)))
    scored = scoring.score_by_language(cases, "news_input", "language", V.ENGLISH_WORDS, V.ENGLISH_WORDS)
    joined = scored.join(sequences.latest_sequence(V.fused(spark, sf_dir), V.FEATURES), "ticker").withColumn(
        "sentiment_seq", sequences.repeated_sentiment(F.col("pos"), F.col("neg"), F.col("neu"), V.FEATURES.window_max))
    judged = P.judge_cases(M.mc_scores(sequences.flat_features(joined), _fitted(spark, sf_dir), ModelSettings(), digits=12))
    return judged.select(
        "case_id", "ticker", "language", "sentiment_polarity", "expected_model_output", "actual_model_output", "match_expected",
        *_r("prob_up", "variance", "confidence"), F.col("trade_date").alias("latest_price_date_used"))


QUERIES = {
    f.__name__: f for f in (
        tier1_source_accuracy, tier1_ema, fisher_diagonal, ewc_nudge_step, ewc_penalty, mc_mean_var, predict_latest, polarity_map,
        temperature_softmax, distill_loss, supported_cases_semi, dropped_anti, qualitative_cases, match_rate,
        model_fit_score, model_predictions, model_cases,
    )
}

_ACC = """
    SELECT coalesce(source, 'default') AS source, count(*) AS n, min(row_id) AS first_seen,
           avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
    FROM prediction_log WHERE correct IS NOT NULL GROUP BY 1"""
_OLD = "(CASE key " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in V.TRUST) + " ELSE 0.5::DOUBLE END)"
_SOFT = ", ".join(f"exp(ln({p} + 1e-9) / 4) AS e_{p}" for p in ("pos", "neg", "neu"))
_TEMPERED = f"""
    SELECT *, e_pos / (e_pos + e_neg + e_neu) AS s0, e_neg / (e_pos + e_neg + e_neu) AS s1,
           e_neu / (e_pos + e_neg + e_neu) AS s2 FROM (SELECT *, {_SOFT} FROM docs_scored)"""


def _log_softmax(logits, t):
    total = " + ".join(f"exp(({x}) / {t}::DOUBLE)" for x in logits)
    return [f"(({x}) / {t}::DOUBLE - ln({total}))" for x in logits]


_LOGITS = ("pos * 3", "neg * 2", "neu * 1")
_KL = " + ".join(f"s{i} * (ln(s{i}) - {q})" for i, q in enumerate(_log_softmax(_LOGITS, 4)))
_CE = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN -{q}" for i, q in enumerate(_log_softmax(_LOGITS, 1))) + " END"

_JUDGED_CASES = f"""
    SELECT *, CASE WHEN pos - neg >= 0.15 THEN 'Positive' WHEN pos - neg <= -0.15 THEN 'Negative' ELSE 'Mixed' END
             AS sentiment_polarity,
           CASE WHEN direction = 'ABSTAIN' THEN 'ABSTAIN' WHEN confidence < 0.2 THEN 'LOW-CONFIDENCE ' || direction
                ELSE direction END AS actual_model_output
    FROM (SELECT *, CASE WHEN v > 0.35 THEN 'ABSTAIN' WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction,
                 round(abs(p - 0.5) * 2 * least(greatest(1 - v, 0), 1), 4) AS confidence,
                 good / (good + bad + 1)::DOUBLE AS pos, bad / (good + bad + 1)::DOUBLE AS neg,
                 1 / (good + bad + 1)::DOUBLE AS neu
          FROM (SELECT case_id, upper(ticker) AS ticker, 'en' AS language, expected_model_output,
                       (case_id * 7919 % 10007) / 10007.0::DOUBLE AS p, (case_id * 31 % 97) / 200.0::DOUBLE AS v,
                       CASE WHEN trim(news_input) = '' THEN 0 ELSE len(list_filter(toks, lambda w: w IN
                         ({", ".join(f"'{w}'" for w in V.ENGLISH_WORDS.positive)}))) END AS good,
                       len(list_filter(toks, lambda w: w IN
                         ({", ".join(f"'{w}'" for w in V.ENGLISH_WORDS.negative)}))) AS bad
                FROM (SELECT *, string_split_regex(lower(news_input), '[^\\p{{L}}\\p{{M}}]+') AS toks FROM cases)
                WHERE upper(ticker) IN (SELECT o_orderstatus FROM orders))) c
    JOIN (SELECT ticker, trade_date AS latest_price_date_used, "window" AS effective_window FROM fused
          WHERE n_rows > 15 AND pos_in_series = n_rows - 1) f USING (ticker)"""


def _nudge_sql() -> str:
    """Both steps as nested aggregates over the rows."""
    names, n = ("x1", "x2", "bias"), NUDGE
    start = dict(zip(names, (*n["weights"], n["bias"])))

    def gradient(source: str) -> str:
        logit = " + ".join(f"t_{c} * {c}" for c in names)
        sums = ", ".join(f"avg((1 / (1 + exp(-({logit}))) - label) * {c}) AS g_{c}" for c in names)
        kept = ", ".join(f"any_value(t_{c}) AS t_{c}" for c in names)
        return f"SELECT s, {kept}, {sums} FROM ({source}) GROUP BY s"

    def step(source: str) -> str:
        full = ", ".join(f"g_{c} + 2 * s * {f}::DOUBLE * (t_{c} - ({start[c]}::DOUBLE)) AS h_{c}" for c, f in zip(names, n["fisher"]))
        size = "sqrt(" + " + ".join(f"h_{c} * h_{c}" for c in names) + ")"
        moved = ", ".join(f"t_{c} - {n['rate']}::DOUBLE * h_{c} * least(1, {n['clip']}::DOUBLE / size) AS t_{c}" for c in names)
        return f"SELECT s, {moved} FROM (SELECT *, {size} AS size FROM (SELECT *, {full} FROM ({gradient(source)})))"

    first = "SELECT s, x1, x2, bias, label, " + ", ".join(f"{start[c]}::DOUBLE AS t_{c}" for c in names) + " FROM nudge_rows, nudge_s"
    second = f"SELECT t.*, x1, x2, bias, label FROM nudge_rows, ({step(first)}) t"
    parts = " UNION ALL ".join(f"SELECT s AS strength, '{c}' AS name, {r6(f't_{c}')} AS theta FROM nudged" for c in names)
    rows = "SELECT variance * 10 AS x1, prob - 0.5 AS x2, 1.0::DOUBLE AS bias, label FROM eval_rows"
    return with_views("eval_rows", f"""
        SELECT * FROM (WITH nudge_rows AS ({rows}), nudge_s AS (SELECT unnest([0.0::DOUBLE, 400.0::DOUBLE]) AS s),
                            nudged AS ({step(second)}) {parts})""")


_MATCH = "CASE WHEN expected_model_output <> '' THEN actual_model_output = expected_model_output END"

ORACLES = {
    "tier1_source_accuracy": with_views(
        "prediction_log", f"SELECT source, n, first_seen, {r6('accuracy')} AS accuracy FROM ({_ACC})"),
    "tier1_ema": with_views("prediction_log", f"""
        SELECT key, {_OLD} AS old_weight, len(steps) AS n_sources,
               {r6('list_reduce(steps, lambda w, a: round(least(greatest(0.95::DOUBLE * w + (1 - 0.95::DOUBLE) * a, 0.1::DOUBLE), 1.0::DOUBLE), 4), ' + _OLD + ')')}
               AS new_weight
        FROM (SELECT key, list(accuracy ORDER BY first_seen) AS steps
              FROM (SELECT *, {key_case('source')} AS key FROM ({_ACC})) GROUP BY 1)"""),
    "fisher_diagonal": with_views("eval_rows", f"""
        WITH grads AS (SELECT row_id % 50 AS b, avg((prob - label) * variance * 10) AS x1,
                              avg((prob - label) * (prob - 0.5)) AS x2, avg(prob - label) AS bias
                       FROM eval_rows GROUP BY 1)
        SELECT name, {r6('f')} AS fisher FROM (
          SELECT 'x1' AS name, sum(x1 * x1) / 50 AS f FROM grads UNION ALL
          SELECT 'x2', sum(x2 * x2) / 50 FROM grads UNION ALL SELECT 'bias', sum(bias * bias) / 50 FROM grads)
        """.replace("WITH grads AS", "SELECT * FROM (WITH grads AS") + ")"),
    "ewc_nudge_step": _nudge_sql(),
    "ewc_penalty": f"""
        SELECT {r6('400 * sum(f * (t - r) * (t - r))')} AS penalty FROM (
          SELECT avg(l_discount) AS t, avg(l_tax) AS r, avg(l_quantity) / 50 AS f
          FROM lineitem GROUP BY l_returnflag, l_suppkey)""",
    "mc_mean_var": with_views("eval_rows", f"""
        SELECT row_id, {r6('m')} AS mc_prob, {r6('v')} AS mc_var,
               CASE WHEN v > 1 - 0.93::DOUBLE THEN 'ABSTAIN' WHEN m >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction,
               {r6('abs(m - 0.5) * 2 * least(greatest(1 - v, 0), 1)')} AS confidence
        FROM (SELECT row_id, avg(p) AS m, var_samp(p) AS v FROM (
                SELECT row_id, 1 / (1 + exp(-((prob - 0.5) * 4
                         + ((row_id * 31 + i * 7919) % 10007 / 10007.0::DOUBLE - 0.5) * 8))) AS p
                FROM eval_rows, (SELECT unnest(range(1, {PASSES + 1})) AS i)) GROUP BY 1)"""),
    "predict_latest": with_views("scored_days", """
        SELECT ticker, strftime(trade_date, '%Y-%m-%d') AS date, direction, actual_direction,
               CASE WHEN direction = 'ABSTAIN' THEN 'ABSTAIN' WHEN direction = actual_direction THEN 'CORRECT' ELSE 'WRONG' END
                 AS prediction_result, round(prob, 4) AS prob_up, round(variance, 4) AS variance,
               round(abs(prob - 0.5) * 2, 4) AS direction_strength, round(least(greatest(1 - variance, 0), 1), 4) AS stability,
               round(abs(prob - 0.5) * 2 * least(greatest(1 - variance, 0), 1), 4) AS confidence, n_samples
        FROM (SELECT *, CASE WHEN variance > 0.35 THEN 'ABSTAIN' WHEN prob >= 0.5 THEN 'UP' ELSE 'DOWN' END AS direction,
                     CASE WHEN label = 1 THEN 'UP' ELSE 'DOWN' END AS actual_direction,
                     count(*) OVER (PARTITION BY ticker) AS n_samples,
                     row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS age FROM scored_days)
        WHERE age = 1"""),
    "polarity_map": with_views("docs_scored", """
        SELECT doc_id, CASE WHEN pos - neg >= 0.15 THEN 'Positive' WHEN pos - neg <= -0.15 THEN 'Negative' ELSE 'Mixed' END
                 AS polarity,
               CASE WHEN doc_id % 9 = 0 THEN 'ABSTAIN'
                    ELSE CASE WHEN abs(pos - neg) < 0.2 THEN 'LOW-CONFIDENCE ' ELSE '' END
                         || CASE WHEN 0.5 + (pos - neg) / 2 >= 0.5 THEN 'UP' ELSE 'DOWN' END END AS output
        FROM docs_scored"""),
    "temperature_softmax": with_views("docs_scored", f"""
        SELECT doc_id, {r6('s0')} AS pos, {r6('s1')} AS neg, {r6('s2')} AS neu FROM ({_TEMPERED})"""),
    "distill_loss": with_views("docs_scored", f"""
        SELECT lang, {r6(f'avg(0.7::DOUBLE * ({_KL}) + 0.3::DOUBLE * ({_CE}))')} AS loss FROM ({_TEMPERED}) GROUP BY 1"""),
    "supported_cases_semi": with_views("cases", """
        SELECT case_id, upper(ticker) AS ticker, md5(news_input) AS news_key, expected_model_output FROM cases
        WHERE upper(ticker) IN (SELECT upper(o_orderstatus) FROM orders)"""),
    "dropped_anti": with_views("cases", """
        SELECT DISTINCT upper(ticker) AS ticker FROM cases
        WHERE upper(ticker) NOT IN (SELECT upper(o_orderstatus) FROM orders)"""),
    "qualitative_cases": with_views("cases fused", f"""
        SELECT case_id, ticker, language, sentiment_polarity, {r6_all(('pos', 'neg', 'neu'))},
               {r6('pos - neg', 4)} AS net_sentiment, expected_model_output, actual_model_output, {_MATCH} AS match_expected,
               direction AS raw_direction, round(p, 4) AS prob_up, round(v, 4) AS variance, confidence,
               latest_price_date_used, effective_window FROM ({_JUDGED_CASES})"""),
    "match_rate": with_views("cases fused", f"""
        SELECT count(*) FILTER (m) AS matched, count(m) AS total, {r6('count(*) FILTER (m) / count(m)::DOUBLE')} AS match_rate
        FROM (SELECT {_MATCH} AS m FROM ({_JUDGED_CASES}))"""),
}
