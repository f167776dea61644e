"""Walk-forward splits, their sizes, class balance and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from ..functions.timing import split_name


def assign_split(df: DataFrame, bounds: Sequence[tuple[str, str, str]], day: str = "trade_date") -> DataFrame:
    """Rows inside one of the date ranges, with the range's name."""
    return df.withColumn("split", split_name(day, bounds)).filter(F.col("split").isNotNull())


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(*[
        F.count_if(F.col("split") == name).alias(f"n_{name}") for name in ("train", "val", "test")
    ])


def positive_weight(df: DataFrame) -> DataFrame:
    """n_neg / (n_pos + 1e-9) over the training split."""
    totals = df.filter(F.col("split") == "train").agg(
        F.sum("label").alias("n_pos"), F.count("label").alias("n")
    )
    n_neg = F.col("n") - F.col("n_pos")
    return totals.select(
        "n_pos", n_neg.alias("n_neg"), (n_neg / (F.col("n_pos") + 1e-9)).alias("pos_weight")
    )


def hash_order(key: Column | str, seed: int) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws("-", as_col(key).cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows, chosen by a seeded hash order (a top-k, no full sort)."""
    return df.orderBy(hash_order(key, seed), key).limit(cap)


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def distillation_rows(df: DataFrame) -> DataFrame:
    """Rows with text and a known label name, mapped to the class index."""
    hard = F.when(F.col("label_name") == "positive", 0).when(F.col("label_name") == "neutral", 1).when(
        F.col("label_name") == "negative", 2)
    return df.withColumn("hard_int", hard).na.drop(subset=["hard_int", "text"])
