"""Text models fitted on labelled texts: a second-language scorer and a language detector.

The scorer is a Spark ML pipeline (hashed character n-grams, multinomial regression) that is saved and loaded as such; it scores
columns inside the JVM. The detector is a table of character n-gram log-likelihoods per language, joined to the n-grams of a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import devanagari_ratio, strip
from .scoring import SCORES
from .splits import distillation_rows

INPUT = "_model_text"


def scorer_stages(sizes: Sequence[int] = (1, 2, 3), buckets: int = 1 << 11, penalty: float = 1e-4, rounds: int = 25) -> Pipeline:
    signs = RegexTokenizer(inputCol=INPUT, outputCol="_signs", pattern="(?s).", gaps=False, toLowercase=True)
    stages = [signs]
    for n in sizes:
        stages += [NGram(n=n, inputCol="_signs", outputCol=f"_grams{n}"), HashingTF(inputCol=f"_grams{n}", outputCol=f"_counts{n}", numFeatures=buckets)]
    stages += [
        VectorAssembler(inputCols=[f"_counts{n}" for n in sizes], outputCol="_all"), Normalizer(inputCol="_all", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="hard_int", family="multinomial", regParam=penalty, maxIter=rounds, probabilityCol="_probs", predictionCol="_class", rawPredictionCol="_raw"),
    ]
    return Pipeline(stages=stages)


def fit_scorer(texts: DataFrame, **options) -> PipelineModel:
    """Fit on ``text, label_name`` (positive, neutral, negative); other labels and rows without text are left out."""
    rows = distillation_rows(texts.select("text", "label_name")).withColumnRenamed("text", INPUT)
    return scorer_stages(**options).fit(rows)


def model_scores(df: DataFrame, text: str | Column, model: PipelineModel) -> DataFrame:
    """Adds pos, neg and neu; NULL text counts as empty."""
    given = df.withColumn(INPUT, F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    scored = model.transform(given).withColumn("_p", vector_to_array("_probs"))
    classes = dict(zip(("pos", "neu", "neg"), range(3), strict=True))  # the order of ``distillation_rows``
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c not in SCORES], *[F.col("_p")[classes[c]].alias(c) for c in SCORES])


def load_scorer(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_scorer(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def grams(text: Column | str, size: int = 3) -> Column:
    """All runs of ``size`` characters of the lower-cased text, in one pass over it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def fit_detector(texts: DataFrame, langs: Sequence[str], text: str = "text", lang: str = "lang", size: int = 3) -> DataFrame:
    """``gram, <lang>...``: log-likelihood of each n-gram in each language, counts raised by one.

    The row whose gram is NULL holds for n-grams that no language has shown.
    """
    counts = texts.where(F.col(lang).isin(*langs)).select(F.explode(grams(text, size)).alias("gram"), F.col(lang).alias("lang")).groupBy("gram").agg(
        *[F.count_if(F.col("lang") == name).alias(name) for name in langs])
    full = counts.unionByName(counts.sparkSession.range(1).select(F.lit(None).cast("string").alias("gram"), *[F.lit(0).cast("long").alias(name) for name in langs]))
    kinds = counts.agg(F.count("*")).scalar()
    totals = {name: counts.agg(F.coalesce(F.sum(name), F.lit(0))).scalar() for name in langs}
    return full.select("gram", *[F.ln((F.col(name) + 1) / (totals[name] + kinds + 1)).alias(name) for name in langs])


def language_likelihoods(df: DataFrame, key: str, text: str, table: DataFrame, langs: Sequence[str], size: int = 3) -> DataFrame:
    """``key, n_grams, <lang>...``: log-likelihoods of each text; texts shorter than an n-gram have no row.

    Keys must be unique. N-grams are counted per text before anything is shuffled.
    """
    unseen = {name: table.where("gram IS NULL").select(name).scalar() for name in langs}
    each = df.select(F.col(key), F.explode(grams(text, size)).alias("gram"))
    known = each.join(table.where("gram IS NOT NULL"), "gram", "left").groupBy(key).agg(
        F.count("*").alias("n_grams"), F.count(langs[0]).alias("_known"), *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in langs])
    return known.select(key, "n_grams", *[(F.col(name) + (F.col("n_grams") - F.col("_known")) * unseen[name]).alias(name) for name in langs])


def model_language(df: DataFrame, key: str, text: str, table: DataFrame, langs: Sequence[str] = ("en", "hi", "hinglish"), threshold: float = 0.85, size: int = 3) -> DataFrame:
    """``key, language, confidence``: texts in mixed script are hinglish; of the rest the likeliest language decides.

    Blank texts and texts whose language is less sure than ``threshold`` are ``unknown``; confidence is the share of the
    best language among all (NULL where no n-gram spoke).
    """
    scored = language_likelihoods(df, key, text, table, langs, size)
    top = F.greatest(*[F.col(name) for name in langs])
    share = 1.0 / sum((F.exp(F.col(name) - top) for name in langs[1:]), F.exp(F.col(langs[0]) - top))
    best = F.coalesce(*[F.when(F.col(name) == top, F.lit(name)) for name in langs])
    judged = scored.select(key, best.alias("_best"), share.alias("confidence"))
    script = devanagari_ratio(F.coalesce(F.col(text), F.lit("")))
    base = df.select(key, script.alias("_share"), (strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("_blank"))
    label = (
        F.when(F.col("_blank"), "unknown").when((F.col("_share") > 0.05) & (F.col("_share") < 0.85), "hinglish")
        .when(F.coalesce(F.col("confidence") >= threshold, F.lit(False)), F.col("_best")).otherwise("unknown")
    )
    return base.join(judged, key, "left").select(key, label.alias("language"), "confidence")
