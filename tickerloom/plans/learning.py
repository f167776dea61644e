"""Queries over fitted text models, many-name tags, summaries and resumable training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import distill, scoring, second_language as SL, summary, tagging, textgen, training
from ..session import materialize, shared_folder
from . import views as V
from .newsroom import _set_sql
from .sql import r6, r6_all, with_views

OTHER_SETS = tuple(s for s in textgen.DEFAULT_SETS if s.lang != "en")
# Held-out texts: a quarter, by the first hex digit of the text's md5.
HELD_DIGITS = ("0", "1", "2", "3")


def _held(text: str = "text"):
    return F.substring(F.md5(text), 1, 1).isin(*HELD_DIGITS)


def second_language_model(spark, sf_dir):
    """Labels that the saved and reloaded scorer gives to texts it was not fitted on."""
    texts = materialize(textgen.generate(V.table(spark, sf_dir, "events"), "event_id", OTHER_SETS).select("id", "text", "lang", "label_name"), "texts")
    path = shared_folder(spark, "scorer")
    SL.save_scorer(SL.fit_scorer(texts.where(~_held())), path)
    scored = SL.model_scores(texts.where(_held()), "text", SL.load_scorer(path))
    best = F.greatest("pos", "neg", "neu")
    label = F.when(F.col("pos") == best, "positive").when(F.col("neg") == best, "negative").otherwise("neutral")
    return scored.select("id", "lang", label.alias("label_name"))


LANGS = ("en", "hi", "hinglish")
LATIN, MOVED = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x0915 + i) for i in range(26))


def lang_model_label(spark, sf_dir):
    """Languages of whole texts, a third of them moved to Devanagari letters, by n-grams learned from generated texts."""
    texts = textgen.generate(V.table(spark, sf_dir, "events"), "event_id")
    table = materialize(SL.fit_detector(texts, LANGS), "detector")
    moved = F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower("text"), LATIN, MOVED)).otherwise(F.col("text"))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", moved.alias("text"))
    labels = SL.model_language(docs, "doc_id", "text", table, LANGS)
    means = SL.language_likelihoods(docs, "doc_id", "text", table, LANGS)
    each = [rounded(F.col(name) / F.col("n_grams")).alias(f"mean_{name}") for name in LANGS]
    return labels.select("doc_id", "language").join(means.select("doc_id", *each), "doc_id", "left")


STEPS = {"rate": 2.0, "temperature": 4.0, "alpha": 0.7}


def _taught(spark, sf_dir):
    """Rows with two inputs, a softened teacher and a hard label."""
    rows = V.eval_rows(spark, sf_dir)
    teacher = [F.col("prob"), (1 - F.col("prob")) * 0.6, (1 - F.col("prob")) * 0.4]
    return rows.select(
        F.array(F.lit(0), F.lit(1)).alias("slots"), F.array(F.col("variance") * 10, F.col("prob") - 0.5).alias("shares"),
        F.array(*teacher).alias("soft"), (F.col("row_id") % 3).alias("hard"))


def distill_fit_step(spark, sf_dir):
    """Two steps of the student on soft and hard labels."""
    rows = materialize(_taught(spark, sf_dir), "taught")
    student = distill.fit_student(rows, 2, 3, STEPS["temperature"], STEPS["alpha"], rounds=2, rates=(STEPS["rate"],))
    flat = [(i, c, float(student.weights[i, c])) for i in range(3) for c in range(3)]
    return spark.createDataFrame(flat, "input long, class long, weight double").select("input", "class", rounded("weight").alias("weight"))


def distill_native(spark, sf_dir):
    """A student of hashed n-grams taught by the fitted scorer; labels of the texts that neither was fitted on."""
    texts = materialize(textgen.generate(V.table(spark, sf_dir, "events"), "event_id", OTHER_SETS).select("id", "text", "lang", "label_name"), "texts")
    teacher = SL.fit_scorer(texts.where(~_held()))
    seen = SL.model_scores(texts.where(~_held()), "text", teacher)
    soft = F.array("pos", "neu", "neg")
    hard = F.when(F.col("label_name") == "positive", 0).when(F.col("label_name") == "neutral", 1).otherwise(2)
    rows = materialize(distill.gram_features(seen.select("text", soft.alias("soft"), hard.alias("hard")), "text"), "taught-texts")
    student = distill.fit_student(rows, 4096, 3, temperature=1.0, alpha=0.7, rounds=25)
    judged = distill.student_scores(distill.gram_features(texts.where(_held()), "text"), student)
    best = F.array_position("student", F.array_max("student"))
    return judged.select("id", "lang", F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), best.cast("int")).alias("label_name"))


def tag_universe(spark, sf_dir):
    """Whole texts that mention two parts, tagged with the last listed of all part names and their last words."""
    parts = V.table(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    named = parts.select(full.alias("name"), (F.col("p_partkey") + 1_000_000).alias("ord"), F.col("p_partkey").cast("string").alias("tag"))
    last = F.element_at(F.split("p_name", " "), -1)
    short = parts.select(last.alias("name"), F.col("p_partkey").alias("ord"), F.upper(last).alias("tag"))
    n = V.row_count(parts)
    docs = V.table(spark, sf_dir, "documents").select(
        "doc_id", "text", (F.col("doc_id") % n).alias("a"), (F.col("doc_id") * 7 % n).alias("b"))
    for side in ("a", "b"):
        docs = docs.join(parts.select(F.col("p_partkey").alias(side), F.upper(full).alias(f"name_{side}")), side)
    said = docs.select("doc_id", F.concat_ws(" ", "text", "name_a", F.lit("and"), "name_b").alias("said"))
    return tagging.tag_names(said, "said", named.unionByName(short)).select("doc_id", "tag", "n_names")


def summary_extractive(spark, sf_dir):
    """Long bodies in their three most connected sentences; short ones as they are."""
    body = scoring.summarise_long("text", summary.extractive(3))
    return V.table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


TRAIN = {"epochs": 4, "rate": 0.8, "momentum": 0.9}


def train_resume(spark, sf_dir):
    """Training stopped after two epochs and taken up again: measures of all epochs, and which one is named best."""
    rows = materialize(V.eval_rows(spark, sf_dir).select(F.array(F.col("variance") * 10, F.col("prob") - 0.5).alias("features"), "label", "split"), "epoch-rows")
    path = shared_folder(spark, "epochs")
    for epochs in (TRAIN["epochs"] // 2, TRAIN["epochs"]):
        training.train_epochs(rows, path, epochs, TRAIN["rate"], TRAIN["momentum"], scaled=False)
    best = training.promote(spark, path)
    seen = training.history(spark, path)
    return seen.select(
        F.col("epoch").cast("long").alias("epoch"), *[rounded(c).alias(c) for c in ("train_loss", "val_loss", "val_acc")], (F.col("epoch") == best).alias("best"))


QUERIES = {f.__name__: f for f in (
    second_language_model, lang_model_label, distill_fit_step, distill_native, tag_universe, summary_extractive, train_resume,
)}

_OTHER_TEXTS = " UNION ALL ".join(_set_sql(s) for s in OTHER_SETS)
_ALL_TEXTS = " UNION ALL ".join(_set_sql(s) for s in textgen.DEFAULT_SETS)
_HELD_SQL = f"""
    SELECT id, lang, label_name FROM ({_OTHER_TEXTS}) WHERE substr(md5(text), 1, 1) IN ({", ".join(f"'{d}'" for d in HELD_DIGITS)})"""
_MOVED_SQL = f"CASE WHEN doc_id % 3 = 0 THEN translate(lower(text), '{LATIN}', '{MOVED}') ELSE text END"


def _grams_of(source: str, keep: str) -> str:
    """N-grams in linear time: the signs are cut once."""
    return f"""SELECT {keep}, unnest(list_transform(range(1, len(signs) - 1), lambda i: signs[i] || signs[i + 1] || signs[i + 2])) AS gram
               FROM (SELECT {keep}, string_split(lower(text), '') AS signs FROM ({source}))"""


_SHARE = "length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) / greatest(length(text), 1)::DOUBLE"
_DETECT_SQL = f"""
    WITH moved AS (SELECT doc_id, coalesce({_MOVED_SQL}, '') AS text FROM documents),
    counts AS (SELECT gram, {", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS)} FROM ({_grams_of(_ALL_TEXTS, 'lang')}) GROUP BY gram),
    totals AS (SELECT count(*) AS kinds, {", ".join(f"sum({x}) AS n_{x}" for x in LANGS)} FROM counts),
    scored AS (
      SELECT doc_id, count(*) AS n_grams, {", ".join(f"sum(ln((coalesce({x}, 0) + 1) / (n_{x} + kinds + 1)::DOUBLE)) AS {x}" for x in LANGS)}
      FROM ({_grams_of('SELECT * FROM moved', 'doc_id')}) LEFT JOIN counts USING (gram) CROSS JOIN totals GROUP BY doc_id),
    judged AS (
      SELECT *, CASE greatest({", ".join(LANGS)}) {" ".join(f"WHEN {x} THEN '{x}'" for x in LANGS)} END AS best,
             1 / ({" + ".join(f"exp({x} - greatest({', '.join(LANGS)}))" for x in LANGS)}) AS confidence FROM scored)
    SELECT doc_id, CASE WHEN trim(text) = '' THEN 'unknown' WHEN {_SHARE} > 0.05 AND {_SHARE} < 0.85 THEN 'hinglish'
                        WHEN confidence >= 0.85 THEN best ELSE 'unknown' END AS language,
           {", ".join(f"{r6(f'{x} / n_grams')} AS mean_{x}" for x in LANGS)}
    FROM moved LEFT JOIN judged USING (doc_id)"""


def _distill_sql() -> str:
    """Both steps over the rows, weights in one row of columns."""
    inputs, classes, t, alpha = ("x1", "x2", "1.0::DOUBLE"), range(3), STEPS["temperature"], STEPS["alpha"]
    teacher = ("prob", "(1 - prob) * 0.6::DOUBLE", "(1 - prob) * 0.4::DOUBLE")

    def step(weights: str) -> str:
        z = ", ".join(" + ".join(f"w_{i}_{c} * {x}" for i, x in enumerate(inputs)) + f" AS z_{c}" for c in classes)
        soft = " + ".join(f"exp(z_{c} / {t}::DOUBLE)" for c in classes)
        plain = " + ".join(f"exp(z_{c})" for c in classes)
        g = ", ".join(
            f"{alpha}::DOUBLE * (exp(z_{c} / {t}::DOUBLE) / ({soft}) - s_{c}) / {t}::DOUBLE + (1 - {alpha}::DOUBLE) * (exp(z_{c}) / ({plain}) - CASE WHEN hard = {c} THEN 1 ELSE 0 END) AS g_{c}"
            for c in classes)
        moved = ", ".join(f"any_value(w_{i}_{c}) - {STEPS['rate']}::DOUBLE * avg(g_{c} * {x}) AS w_{i}_{c}" for i, x in enumerate(inputs) for c in classes)
        return f"SELECT {moved} FROM (SELECT *, {g} FROM (SELECT *, {z} FROM taught, ({weights})))"

    start = "SELECT " + ", ".join(f"0.0::DOUBLE AS w_{i}_{c}" for i in range(3) for c in classes)
    rows = "SELECT variance * 10 AS x1, prob - 0.5 AS x2, row_id % 3 AS hard, " + ", ".join(f"{p} AS s_{c}" for c, p in enumerate(teacher)) + " FROM eval_rows"
    out = " UNION ALL ".join(f"SELECT {i} AS input, {c} AS class, {r6(f'w_{i}_{c}')} AS weight FROM stepped" for i in range(3) for c in classes)
    return with_views("eval_rows", f"SELECT * FROM (WITH taught AS ({rows}), stepped AS ({step(step(start))}) {out})")


def _epochs_sql() -> str:
    """Each epoch's weights and velocity from the epoch before; the measures at each."""
    inputs = ("x1", "x2", "1.0::DOUBLE")
    ctes = ["rows_ AS (SELECT variance * 10 AS x1, prob - 0.5 AS x2, label, split FROM eval_rows)",
            "e0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w_{i}, 0.0::DOUBLE AS v_{i}" for i in range(3)) + ")"]
    for k in range(TRAIN["epochs"]):
        z = " + ".join(f"w_{i} * {x}" for i, x in enumerate(inputs))
        ctes.append(f"g{k} AS (SELECT " + ", ".join(f"any_value(w_{i}) AS w_{i}, any_value(v_{i}) AS v_{i}, avg((1 / (1 + exp(-({z}))) - label) * {x}) AS g_{i}" for i, x in enumerate(inputs))
                    + f" FROM rows_, e{k} WHERE split = 'train')")
        v = [f"{TRAIN['momentum']}::DOUBLE * v_{i} - {TRAIN['rate']}::DOUBLE * g_{i}" for i in range(3)]
        ctes.append(f"e{k + 1} AS (SELECT " + ", ".join(f"w_{i} + {v[i]} AS w_{i}, {v[i]} AS v_{i}" for i in range(3)) + f" FROM g{k})")
    z = " + ".join(f"w_{i} * {x}" for i, x in enumerate(inputs))
    loss = f"ln(1 + exp(-abs({z}))) + greatest({z}, 0) - label * ({z})"
    each = " UNION ALL ".join(
        f"SELECT {k} AS epoch, avg(CASE WHEN split = 'train' THEN {loss} END) AS train_loss, avg(CASE WHEN split = 'val' THEN {loss} END) AS val_loss, "
        f"avg(CASE WHEN split = 'val' THEN CASE WHEN ({z} > 0) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END END) AS val_acc FROM rows_, e{k}" for k in range(TRAIN["epochs"] + 1))
    return with_views("eval_rows", f"""
        SELECT * FROM (WITH {", ".join(ctes)}, measured AS ({each})
          SELECT epoch, {r6_all(('train_loss', 'val_loss', 'val_acc'))}, row_number() OVER (ORDER BY val_acc DESC, epoch) = 1 AS best FROM measured)""")




def _full_name(side: str = "") -> str:
    return f"{side}p_name || ' ' || {side}p_brand || ' ' || {side}p_type"


ORACLES = {
    "second_language_model": _HELD_SQL,
    "distill_native": _HELD_SQL,
    "lang_model_label": _DETECT_SQL,
    "distill_fit_step": _distill_sql(),
    "train_resume": _epochs_sql(),
    "tag_universe": f"""
        WITH listed AS (
          SELECT name, max(ord) AS ord, arg_max(tag, ord) AS tag FROM (
            SELECT lower({_full_name()}) AS name, p_partkey + 1000000 AS ord, p_partkey::VARCHAR AS tag FROM part
            UNION ALL SELECT lower(string_split(p_name, ' ')[-1]), p_partkey, upper(string_split(p_name, ' ')[-1]) FROM part) GROUP BY name),
        said AS (
          SELECT doc_id, lower(concat_ws(' ', text, upper({_full_name('a.')}), 'and', upper({_full_name('b.')}))) AS said
          FROM documents d JOIN part a ON a.p_partkey = d.doc_id % (SELECT count(*) FROM part) JOIN part b ON b.p_partkey = d.doc_id * 7 % (SELECT count(*) FROM part))
        SELECT doc_id, coalesce(arg_max(tag, ord), '') AS tag, count(ord) AS n_names FROM said LEFT JOIN listed ON contains(said, name) GROUP BY doc_id""",
    "summary_extractive": """
        WITH bodies AS (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), '') AS body FROM documents),
        cut AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(body, '[^.!?]+[.!?]*'), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM bodies WHERE length(body) > 150),
        each AS (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS i, len(sentences) AS n FROM cut),
        held AS (SELECT DISTINCT doc_id, i, n, unnest(regexp_extract_all(lower(sentence), '[a-z0-9à-ÿऀ-ॿ]+')) AS word FROM each),
        weighed AS (SELECT doc_id, i, word, length(bin(n // count(*) OVER (PARTITION BY doc_id, word))) AS weight, count(*) OVER (PARTITION BY doc_id, i) AS size FROM held),
        own AS (SELECT doc_id, i, sum(weight) AS own FROM weighed GROUP BY ALL),
        round1 AS (SELECT doc_id, i, sum(weight * shared) - any_value(own) AS rank FROM (
          SELECT doc_id, i, weight, count(*) OVER (PARTITION BY doc_id, word) AS shared FROM weighed) JOIN own USING (doc_id, i) GROUP BY ALL),
        round2 AS (SELECT doc_id, i, (sum(weight * shared) - any_value(own) * any_value(rank))::DOUBLE / any_value(size) AS rank FROM (
          SELECT doc_id, i, weight, size, rank, sum(rank) OVER (PARTITION BY doc_id, word) AS shared FROM weighed JOIN round1 USING (doc_id, i)) JOIN own USING (doc_id, i) GROUP BY ALL),
        best AS (SELECT doc_id, i, sentence FROM each LEFT JOIN round2 USING (doc_id, i) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(rank, 0) DESC, i) <= 3),
        joined AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY i) AS summary FROM best GROUP BY doc_id)
        SELECT doc_id, CASE WHEN length(body) > 150 THEN coalesce(summary, body) ELSE body END AS body FROM bodies LEFT JOIN joined USING (doc_id)""",
}
