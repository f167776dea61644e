"""Text scorers: a native word-list scorer and an interface for model plug-ins.

A scorer turns a text column into pos / neg / neu scores that sum to one.  The
default counts list words with built-in functions and stays in the JVM; model
scorers are wrapped as iterator pandas UDFs that load once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import as_col

SCORES = ("pos", "neg", "neu")
# Letters with the signs that belong to them: Devanagari vowel signs are marks, not letters.
NOT_LETTERS = "[^\\p{L}\\p{M}]+"


@dataclass(frozen=True)
class WordLists:
    positive: tuple[str, ...]
    negative: tuple[str, ...]


MARKET_WORDS = WordLists(
    positive=(
        "beat", "beats", "bullish", "buy", "gain", "gains", "growth", "high", "jump", "jumps", "profit",
        "rally", "rallies", "record", "recovery", "rise", "rises", "robust", "strong", "surge", "surges",
        "upgrade", "win", "wins",
    ),
    negative=(
        "bearish", "crash", "decline", "down", "downgrade", "drop", "drops", "fall", "falls", "fraud", "loss",
        "losses", "low", "miss", "misses", "penalty", "plunge", "selloff", "slump", "weak", "weaken", "worst",
    ),
)
MIXED_LANGUAGE_WORDS = WordLists(
    positive=MARKET_WORDS.positive + ("tezi", "badhat", "munafa", "mazboot", "faayda", "तेजी", "चढ़े", "चढ़ा", "मुनाफा", "लाभ", "मजबूत",
                                      "बढ़ा", "बढ़त", "उछाल", "वृद्धि"),
    negative=MARKET_WORDS.negative + ("girawat", "nuksan", "kamzor", "mandi", "ghata", "गिरा", "गिरे", "गिरावट", "नुकसान", "घाटा",
                                      "कमजोर", "टूटे", "मंदी", "जुर्माना"),
)


def listed_words(text: Column | str, words: WordLists) -> Column:
    """The text's words that are on either list, in order, duplicates kept."""
    tokens = F.split(F.lower(F.coalesce(as_col(text), F.lit(""))), NOT_LETTERS)
    return F.filter(tokens, lambda w: w.isin(*words.positive, *words.negative))


def score_by_language(df: DataFrame, text: str, lang: str, english: WordLists = MARKET_WORDS,
                      other: WordLists = MIXED_LANGUAGE_WORDS,
                      other_langs: Sequence[str] = ("hi", "hinglish"), other_model=None) -> DataFrame:
    """Route every row to its language's scorer in place; no split-and-rejoin.

    pos = hits / (hits + misses + 1), neg alike, neu the rest; text without
    list words is neutral, and so are rows of neither language class.  The text
    is tokenised once; the counts run over the few listed words that are left.
    A fitted ``other_model`` (see ``second_language``) scores the other languages in place of their list.
    """
    if other_model is not None:
        from .second_language import model_scores

        listed = score_by_language(df, text, lang, english, other, other_langs)
        kept = listed.withColumn("_listed", F.struct(*SCORES))
        fitted = model_scores(kept, F.when(F.col(lang).isin(*other_langs), F.col(text)), other_model)
        chosen = {c: F.when(F.col(lang).isin(*other_langs), F.col(c)).otherwise(F.col("_listed")[c]) for c in SCORES}
        return fitted.withColumns(chosen).drop("_listed")
    is_en, is_other = F.col(lang) == "en", F.col(lang).isin(*other_langs)
    kept = F.when(is_en, listed_words(text, english)).when(is_other, listed_words(text, other)).otherwise(
        F.array().cast("array<string>"))
    positive = F.when(is_en, F.size(F.filter("_kept", lambda w: w.isin(*english.positive)))).otherwise(
        F.size(F.filter("_kept", lambda w: w.isin(*other.positive))))
    counted = df.withColumn("_kept", kept).withColumns({"_good": positive, "_all": F.size("_kept")})
    total = F.col("_all") + F.lit(1)
    return counted.withColumns({
        "pos": F.col("_good") / total, "neg": (F.col("_all") - F.col("_good")) / total, "neu": F.lit(1.0) / total,
    }).drop("_kept", "_good", "_all")


def model_scorer(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]):
    """Wrap a model as a vectorised UDF returning struct<pos, neg, neu>.

    ``load`` runs once per Python worker and returns a function from a batch of
    texts to a frame with the three score columns in any order.  Batch size
    follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf("pos double, neg double, neu double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for texts in batches:
            yield predict(texts.fillna(""))[list(SCORES)].astype("float64")

    return score


def missing_scores(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """Articles that have no stored score yet (keyed by content, not by position)."""
    return articles.join(scored.select("row_hash"), "row_hash", "left_anti")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def score_with_store(articles: DataFrame, score: Column, path: str) -> DataFrame:
    """Articles with scores, computing only what the store at ``path`` lacks.

    ``score`` is a struct<pos, neg, neu> column.  One score per row_hash is
    appended to the store; a rerun after a failure continues from there.
    Articles without a score get the neutral vector.
    """
    spark = articles.sparkSession
    schema = "row_hash string, pos double, neg double, neu double"
    todo = articles.dropDuplicates(["row_hash"])
    if path_exists(spark, path):
        todo = missing_scores(todo, spark.read.schema(schema).parquet(path))
    fresh = todo.select("row_hash", score.alias("_s")).select("row_hash", "_s.*")
    fresh.na.drop(subset=list(SCORES)).write.mode("append").parquet(path)
    stored = spark.read.schema(schema).parquet(path).dropDuplicates(["row_hash"])  # two runs may overlap
    neutral = {"pos": F.coalesce("pos", F.lit(0.0)), "neg": F.coalesce("neg", F.lit(0.0)), "neu": F.coalesce("neu", F.lit(1.0))}
    return articles.join(stored, "row_hash", "left").withColumns(neutral)


def reorder_scores(values: Column | str, labels: Sequence[str]) -> dict[str, Column]:
    """Map a model's probability array to pos / neg / neu by its label names."""
    values = as_col(values)
    out = {c: F.lit(0.0) for c in SCORES}
    for position, label in enumerate(labels, start=1):
        low = label.lower()
        target = "pos" if "pos" in low else "neg" if "neg" in low else "neu"
        out[target] = F.element_at(values, position)
    return out


def summarise_long(
    text: Column | str, summariser=None, trigger: int = 150, limit: int | None = None, window: int | None = None,
) -> Column:
    """Cleaned text; texts longer than ``trigger`` go through a model when one is given.

    ``limit`` cuts what is not summarised, ``window`` what a model with a bounded input is shown; by default
    nothing is cut.
    """
    from ..functions.text import drop_breaks

    clean = drop_breaks(text)
    plain = clean if limit is None else F.substring(clean, 1, limit)
    if summariser is None:
        return plain
    return F.when(F.length(clean) > trigger, F.coalesce(summariser(clean if window is None else F.substring(clean, 1, window)), plain)).otherwise(plain)
