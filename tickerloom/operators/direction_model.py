"""Default direction model: regularised logistic regression over flat sequences.

Stands in for the recurrent two-branch network, which needs a deep-learning
runtime this package does not depend on.  Training is Spark ML; dropout at
inference masks the inputs with a fixed set of seeded masks, one per pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decisions import sigmoid
from ..settings import ModelSettings, TrainingSettings
from .adaptive import fisher_diagonal
from .splits import positive_weight


@dataclass(frozen=True)
class DirectionModel:
    """Weights on raw inputs; length is fixed by the sequence shape (300 by default)."""

    weights: tuple[float, ...]
    bias: float
    history: tuple[float, ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("weight", i, float(w)) for i, w in enumerate(self.weights)] + [("bias", 0, float(self.bias))]
        return spark.createDataFrame(rows, "name string, idx int, value double")

    @staticmethod
    def from_table(table: DataFrame) -> "DirectionModel":
        rows = table.orderBy("name", "idx").collect()  # one row per model weight
        return DirectionModel(
            tuple(r.value for r in rows if r.name == "weight"),
            next(r.value for r in rows if r.name == "bias"),
        )


def fit(samples: DataFrame, opts: TrainingSettings = TrainingSettings()) -> DirectionModel:
    """Fit on the train split of samples with ``features``, ``label`` and ``split``.

    Positives are weighted by the class ratio.  Raises when no training row exists.
    """
    balance = positive_weight(samples).first()
    if not balance or balance["n_pos"] is None or balance["n_pos"] + balance["n_neg"] == 0:
        raise ValueError("No training data available: check the split dates against the sample dates.")
    data = samples.filter(F.col("split") == "train").select(
        array_to_vector("features").alias("raw"), "label",
        F.when(F.col("label") == 1, F.lit(float(balance["pos_weight"]))).otherwise(1.0).alias("w"),
    )
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(data)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="w", regParam=opts.weight_decay,
        maxIter=opts.epochs, standardization=False,
    ).fit(scaler.transform(data))
    std = np.asarray(scaler.std.toArray())
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    weights = np.asarray(fitted.coefficients.toArray()) * scale
    bias = float(fitted.intercept) - float(np.dot(weights, scaler.mean.toArray()))
    return DirectionModel(tuple(weights.tolist()), bias, tuple(fitted.summary.objectiveHistory))


def mc_scores(samples: DataFrame, model: DirectionModel, opts: ModelSettings = ModelSettings(),
              seed: int = 123, digits: int = 4) -> DataFrame:
    """prob and variance over seeded dropout passes, one matrix product per Arrow batch."""
    rng = np.random.default_rng(seed)
    keep = 1.0 - opts.dropout
    masks = (rng.random((opts.mc_dropout_passes, len(model.weights))) < keep) / keep
    masked = (masks * np.asarray(model.weights)).T
    bias = model.bias

    @F.pandas_udf("prob double, variance double")
    def passes(features: pd.Series) -> pd.DataFrame:
        logits = np.stack(features.to_numpy()) @ masked + bias
        probs = 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))
        return pd.DataFrame({"prob": probs.mean(axis=1), "variance": probs.var(axis=1, ddof=1)})

    scored = samples.withColumn("_mc", passes("features"))
    return scored.withColumns({
        "prob": F.round("_mc.prob", digits), "variance": F.round("_mc.variance", digits),
    }).drop("_mc")


def _batch_sums(samples: DataFrame, model: DirectionModel) -> DataFrame:
    """Per input: gradient sum and row count, reduced inside tasks first."""
    weights, bias = np.asarray(model.weights), model.bias

    def reduce_batches(batches):
        grad = None
        rows = 0
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["features"].to_numpy())
            x = np.hstack([x, np.ones((len(x), 1))])
            p = 1.0 / (1.0 + np.exp(-np.clip(x[:, :-1] @ weights + bias, -500, 500)))
            g = (p - pdf["label"].to_numpy())[:, None] * x
            grad = g.sum(axis=0) if grad is None else grad + g.sum(axis=0)
            rows += len(x)
        if grad is not None:
            yield pd.DataFrame({"idx": np.arange(len(grad)), "grad": grad, "n": rows})

    partial = samples.select("features", "label").mapInPandas(
        reduce_batches, "idx int, grad double, n long"
    )
    return partial.groupBy("idx").agg(F.sum("grad").alias("grad"), F.sum("n").alias("n"))


def with_prob(samples: DataFrame, model: DirectionModel) -> DataFrame:
    """Adds the model's probability without dropout."""
    weights = F.array(*[F.lit(float(w)) for w in model.weights])
    logit = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(float(model.bias)), lambda a, x: a + x)
    return samples.withColumn("prob", sigmoid(logit))


def fisher(samples: DataFrame, model: DirectionModel, n_batches: int = 50) -> np.ndarray:
    """Fisher terms per weight (bias last) over ``n_batches`` batches, dealt by a hash of the inputs."""
    rows = with_prob(samples, model).select(
        F.concat("features", F.array(F.lit(1.0))).alias("features"), "label", "prob",
        F.pmod(F.xxhash64("features", "label"), F.lit(n_batches)).alias("batch"),
    )
    got = fisher_diagonal(rows, n_batches=n_batches).orderBy("idx").collect()  # one row per model weight
    return np.array([r.fisher for r in got])


def ewc_nudge(recent: DataFrame, model: DirectionModel, fisher_diag: np.ndarray, strength: float = 400.0,
              rate: float = 1e-5, steps: int = 5, clip: float = 0.5) -> DirectionModel:
    """Gradient steps on recent samples, anchored to the weights from before the first one.

    The penalty is zero where the steps start and pulls back from the second one on.

    The data gradient is a distributed sum; the driver only holds the weights.
    """
    anchor = np.array([*model.weights, model.bias])
    theta = anchor.copy()
    for _ in range(steps):
        current = DirectionModel(tuple(theta[:-1]), float(theta[-1]))
        rows = _batch_sums(recent, current).orderBy("idx").collect()  # one row per model weight
        if not rows:
            return model
        grad = np.array([r.grad / r.n for r in rows]) + 2.0 * strength * fisher_diag * (theta - anchor)
        norm = np.linalg.norm(grad)
        theta = theta - rate * (grad * min(1.0, clip / norm) if norm > 0 else grad)
    return DirectionModel(tuple(theta[:-1].tolist()), float(theta[-1]), model.history)
