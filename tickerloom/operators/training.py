"""Training of the direction model epoch by epoch, with stored state.

An epoch is one distributed pass: at the epoch's weights it adds up the gradient and loss of the train split and loss and hits of the
validation split. Weights, velocity, gradient and measures are written to a folder of their own before the next epoch, so
that a run that stops is taken up after its last whole epoch and ends with the same weights as one that did not. The epoch
with the best validation accuracy is named by a pointer file; folders that are neither best nor last can be pruned.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import Folder
from . import evaluation as E
from .direction_model import DirectionModel

POINTER = "best.json"
STATE = "name string, idx int, value double"
MEASURES = ("train_loss", "train_rows", "val_loss", "val_acc", "val_rows")


@dataclass(frozen=True)
class Epoch:
    """State after ``number`` updates; all arrays have the bias last and apply to scaled inputs."""

    number: int
    weights: np.ndarray
    velocity: np.ndarray
    gradient: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    measures: dict[str, float]

    def model(self) -> DirectionModel:
        """The model over unscaled inputs."""
        w = self.weights[:-1] * self.scale
        return DirectionModel(tuple(w.tolist()), float(self.weights[-1] - w @ self.mean))


def _moments(rows: DataFrame, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and 1 / deviation of each input over the train split (0 where constant); without scaling 0 and 1."""
    train = rows.where("split = 'train'")
    if not scaled:
        size = train.select(F.size("features")).limit(1).collect()
        n = size[0][0] if size else 0
        return np.zeros(n), np.ones(n)
    each = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    s = np.array([r.s for r in each])
    return np.array([r.m for r in each]), np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)


def _measured(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    def partial(batches):
        grad, sums = np.zeros(len(weights)), np.zeros(5)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (np.stack(batch.column("features").to_numpy(zero_copy_only=False)) - mean) * scale
            x = np.hstack([x, np.ones((len(x), 1))])
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            z = np.clip(x @ weights, -500, 500)
            loss = np.logaddexp(0, z) - y * z
            grad += ((1 / (1 + np.exp(-z)) - y) * train) @ x
            sums += [loss[train].sum(), train.sum(), loss[~train].sum(), ((z > 0) == (y > 0.5))[~train].sum(), (~train).sum()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(weights) + 5), pa.int32()), "v": np.concatenate([grad, sums])})

    got = rows.where("split IN ('train', 'val')").select(
        F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"), (F.col("split") == "train").alias("train"),
    ).mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # a row per weight
    v = np.array([r.v for r in got]) if got else np.zeros(len(weights) + 5)
    loss, n, val_loss, hits, n_val = v[-5:]
    return v[:-5] / max(1, n), {"train_loss": loss / max(1, n), "train_rows": n, "val_loss": val_loss / max(1, n_val), "val_acc": hits / max(1, n_val), "val_rows": n_val}


def _save(spark: SparkSession, path: str, e: Epoch) -> None:
    rows = [(name, i, float(x)) for name in ("weights", "velocity", "gradient", "mean", "scale") for i, x in enumerate(getattr(e, name))]
    rows += [(name, -1, float(x)) for name, x in e.measures.items()]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={e.number:05d}")


def stored_epochs(spark: SparkSession, path: str) -> list[int]:
    """Whole epochs only: a folder without a mark of success is left from a run that stopped."""
    folder = Folder(spark, path)
    return [int(n.split("=")[1]) for n in folder.names() if n.startswith("epoch=") and folder.has(f"{n}/_SUCCESS")]


def load_epoch(spark: SparkSession, path: str, number: int) -> Epoch:
    got = spark.read.schema(STATE).parquet(f"{path}/epoch={number:05d}").orderBy("idx").collect()  # a few rows per weight
    arrays = {name: np.array([r.value for r in got if r.name == name]) for name in ("weights", "velocity", "gradient", "mean", "scale")}
    return Epoch(number, **arrays, measures={r.name: r.value for r in got if r.idx < 0})


def train_epochs(rows: DataFrame, path: str, epochs: int, rate: float = 0.5, momentum: float = 0.9, decay: float = 0.0, scaled: bool = True) -> Epoch:
    """Full-batch steps with momentum on ``features, label, split``, continued from what ``path`` holds; the last epoch."""
    spark = rows.sparkSession
    there = stored_epochs(spark, path)
    if there:
        now = load_epoch(spark, path, max(there))
    else:
        mean, scale = _moments(rows, scaled)
        start = np.zeros(len(mean) + 1)
        grad, measures = _measured(rows, start, mean, scale)
        now = Epoch(0, start, np.zeros_like(start), grad, mean, scale, measures)
        _save(spark, path, now)
    while now.number < epochs:
        pull = decay * np.append(now.weights[:-1], 0.0)
        velocity = momentum * now.velocity - rate * (now.gradient + pull)
        weights = now.weights + velocity
        grad, measures = _measured(rows, weights, now.mean, now.scale)
        now = Epoch(now.number + 1, weights, velocity, grad, now.mean, now.scale, measures)
        _save(spark, path, now)
    return now


def history(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, train_loss, train_rows, val_loss, val_acc, val_rows`` of all stored epochs."""
    there = sorted(stored_epochs(spark, path))
    if not there:
        return spark.createDataFrame([], "epoch int, " + ", ".join(f"{m} double" for m in MEASURES))
    rows = spark.read.schema(STATE + ", epoch int").option("basePath", path).parquet(*[f"{path}/epoch={n:05d}" for n in there])
    return rows.where("idx < 0").groupBy("epoch").pivot("name", list(MEASURES)).agg(F.max("value"))


def promote(spark: SparkSession, path: str) -> int:
    """Names the epoch with the best validation accuracy (ties: the earlier) in the pointer file."""
    best = E.best_epoch(history(spark, path).select("epoch", "val_acc")).first()
    folder = Folder(spark, path)
    folder.write_text(POINTER, json.dumps({"epoch": int(best.epoch), "val_acc": float(best.val_acc)}))
    return int(best.epoch)


def promoted(spark: SparkSession, path: str) -> Epoch:
    return load_epoch(spark, path, json.loads(Folder(spark, path).read_text(POINTER))["epoch"])


def prune(spark: SparkSession, path: str) -> list[int]:
    """Removes all epochs but the named and the last one; the numbers that stay."""
    there = stored_epochs(spark, path)
    keep = {max(there), json.loads(Folder(spark, path).read_text(POINTER))["epoch"]} if there else set()
    folder = Folder(spark, path)
    for n in set(there) - keep:
        folder.remove(f"epoch={n:05d}")
    return sorted(keep)
