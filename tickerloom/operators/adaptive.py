"""Source-trust updates and elastic weight consolidation terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.matching import first_key_in


def weights_table(spark: SparkSession, weights: Iterable[tuple[str, float]]) -> DataFrame:
    """The configured weights as an ordered table (a handful of rows)."""
    rows = [(i, k, float(w)) for i, (k, w) in enumerate(weights)]
    return spark.createDataFrame(rows, "ord int, key string, weight double")


def source_accuracy(log: DataFrame, order: str) -> DataFrame:
    """Accuracy per source over judged predictions, with the source's first position."""
    return (
        log.filter(F.col("correct").isNotNull())
        .groupBy(F.coalesce("source", F.lit("default")).alias("source"))
        .agg(
            F.avg(F.col("correct").cast("int")).alias("accuracy"),
            F.count(F.lit(1)).alias("n"),
            F.min(order).alias("first_seen"),
        )
    )


def update_weights(accuracy: DataFrame, weights: Iterable[tuple[str, float]], decay: float = 0.95) -> DataFrame:
    """New weight per configured key that saw predictions.

    Sources that resolve to one key are folded in order of first appearance,
    each step rounded to four digits and kept within [0.1, 1]; rounding makes
    the steps order-dependent, so the fold is sequential: a stream over one
    pre-aggregated row per news source, in order.
    """
    weights = list(weights)
    old = dict(weights)
    start = F.lit(float(old.get("default", 0.5)))
    for key, weight in reversed(weights):
        start = F.when(F.col("key") == key, F.lit(float(weight))).otherwise(start)
    keyed = accuracy.withColumn("key", F.coalesce(first_key_in("source", old), F.lit("default")))
    names = StructType([
        StructField("key", StringType()), StructField("old_weight", DoubleType()), StructField("new_weight", DoubleType()),
        StructField("n_sources", IntegerType()),
    ])
    ordered = keyed.select("key", start.alias("old_weight"), "first_seen", "source", "accuracy").repartition("key").sortWithinPartitions(
        "key", "first_seen", "source")
    return ordered.mapInPandas(lambda it: _folded(it, decay), names)


def _folded(batches: Iterator[pd.DataFrame], decay: float) -> Iterator[pd.DataFrame]:
    """One pass over rows ordered by key: a key's rows are never held together, however many sources it has."""
    key = old = new = None
    n = 0
    for pdf in batches:
        for k, start, accuracy in zip(pdf["key"], pdf["old_weight"], pdf["accuracy"]):
            if k != key:
                if n:
                    yield pd.DataFrame({"key": [key], "old_weight": [old], "new_weight": [new], "n_sources": [n]})
                key, old, new, n = k, start, start, 0
            step = min(max(decay * new + (1.0 - decay) * accuracy, 0.1), 1.0)
            new, n = float(Decimal(repr(float(step))).quantize(Decimal("0.0001"), ROUND_HALF_UP)), n + 1
    if n:
        yield pd.DataFrame({"key": [key], "old_weight": [old], "new_weight": [new], "n_sources": [n]})


def next_weights(spark: SparkSession, updates: DataFrame, weights: Iterable[tuple[str, float]]) -> DataFrame:
    """The full weight table after an update, order preserved."""
    table = weights_table(spark, weights)
    return table.join(updates.select("key", "new_weight"), "key", "left").select(
        "ord", "key", F.coalesce("new_weight", "weight").alias("weight")
    ).orderBy("ord")


def fisher_diagonal(rows: DataFrame, features: str = "features", batch: str = "batch", n_batches: int = 50) -> DataFrame:
    """Diagonal Fisher terms (idx, fisher) of a logistic model: squared batch gradients over ``n_batches``.

    ``features`` is an array column, ``prob`` the model's probability.  The divisor stays ``n_batches`` when fewer
    batches exist.  Gradients are averaged per batch with a map-side part; a row per batch is left.
    """
    error = F.col("prob") - F.col("label")
    vector = array_to_vector(F.transform(features, lambda x: x * error))
    grads = rows.select(F.col(batch).alias("_batch"), vector.alias("_g")).groupBy("_batch").agg(Summarizer.mean(F.col("_g")).alias("_g"))
    terms = grads.select(F.posexplode(vector_to_array("_g")).alias("idx", "g"))
    return terms.groupBy("idx").agg((F.sum(F.col("g") * F.col("g")) / float(n_batches)).alias("fisher"))


def ewc_penalty(params: DataFrame, strength: float = 400.0) -> DataFrame:
    """strength * sum of fisher * (theta - theta_ref)^2 over (name, idx) rows."""
    term = F.col("fisher") * F.pow(F.col("theta") - F.col("theta_ref"), 2.0)
    return params.agg((F.sum(term) * F.lit(float(strength))).alias("penalty"))
