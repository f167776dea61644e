"""A multinomial student fitted on soft labels by distributed gradient sums.

Loss per row: alpha * KL(soft || student at the temperature) + (1 - alpha) * cross entropy with the hard label (the loss of
``decisions.distillation_loss``). Tasks add up gradients and losses; the driver holds the weights only. Each round tries several
step sizes in one pass over the rows and takes the best of those that lower the loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATES = tuple(4.0 / 2 ** k for k in range(10))


@dataclass(frozen=True)
class Student:
    """``weights``: a row per input and one for the bias, a column per class."""

    weights: np.ndarray
    history: tuple[float, ...] = ()


def hashed_grams(texts: Sequence[str], buckets: int, sizes: Sequence[int] = (2, 3)) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Slots of the hashed character n-grams of each text, and their counts scaled to length one."""
    slots, shares = [], []
    for text in texts:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found = [np.zeros(0, np.int64)]
        for size in sizes:
            h = np.zeros(max(0, len(points) - size + 1), np.int64)
            for k in range(size):
                h = (h * 257 + points[k:len(h) + k]) % 1_000_003
            found.append((h * len(sizes) + size) % buckets)
        at, counts = np.unique(np.concatenate(found), return_counts=True)
        slots.append(at)
        shares.append(counts / max(1.0, np.sqrt((counts.astype(float) ** 2).sum())))
    return slots, shares


def gram_features(df: DataFrame, text: str, buckets: int = 4096) -> DataFrame:
    """Adds ``slots`` and ``shares``; NULL text has none."""
    @F.pandas_udf("slots array<int>, shares array<double>")
    def features(texts: pd.Series) -> pd.DataFrame:
        slots, shares = hashed_grams(texts.fillna(""), buckets)
        return pd.DataFrame({"slots": [s.astype(np.int32) for s in slots], "shares": shares})

    return df.withColumn("_f", features(text)).select(*[F.col(f"`{c}`") for c in df.columns], "_f.slots", "_f.shares")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _arrays(batch: pa.RecordBatch):
    """Rows of the entries, slots, values; soft and hard labels."""
    slots, shares = batch.column("slots"), batch.column("shares")
    owner = np.repeat(np.arange(batch.num_rows), np.diff(slots.offsets.to_numpy()))
    soft = np.stack(batch.column("soft").to_numpy(zero_copy_only=False))
    return owner, slots.flatten().to_numpy(), shares.flatten().to_numpy(), soft, batch.column("hard").to_numpy()


def _logits(weights: np.ndarray, owner, slots, values, rows: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values * weights[slots, c], rows) + weights[-1, c] for c in range(weights.shape[1])], axis=1)


def row_losses(logits: np.ndarray, soft: np.ndarray, hard: np.ndarray, temperature: float, alpha: float) -> np.ndarray:
    tiny = np.finfo(float).tiny
    kl = np.where(soft > 0, soft * (np.log(np.maximum(soft, tiny)) - np.log(np.maximum(_softmax(logits / temperature), tiny))), 0).sum(axis=1)
    return alpha * kl - (1 - alpha) * np.log(np.maximum(_softmax(logits)[np.arange(len(hard)), hard], tiny))


def _gradient(rows: DataFrame, weights: np.ndarray, temperature: float, alpha: float) -> tuple[np.ndarray, int]:
    """Mean gradient and number of rows."""
    inputs, classes = weights.shape

    def partial(batches):
        total, n = np.zeros((inputs, classes)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, slots, values, soft, hard = _arrays(batch)
            z = _logits(weights, owner, slots, values, batch.num_rows)
            g = alpha * (_softmax(z / temperature) - soft) / temperature + (1 - alpha) * (_softmax(z) - np.eye(classes)[hard])
            for c in range(classes):
                total[:-1, c] += np.bincount(slots, values * g[owner, c], inputs - 1)
            total[-1] += g.sum(axis=0)
            n += batch.num_rows
        if n:
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1), pa.int32()), "v": np.append(total.ravel()[at], float(n))})

    sums = rows.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # a row per weight
    out, n = np.zeros(inputs * classes), 0
    for r in sums:
        if r["at"] < 0:
            n = int(r.v)
        else:
            out[r["at"]] = r.v
    return out.reshape(inputs, classes) / max(1, n), n


def losses(rows: DataFrame, tried: Sequence[np.ndarray], temperature: float, alpha: float) -> list[float]:
    """Mean loss of several weight sets in one pass."""

    def partial(batches):
        total, n = np.zeros(len(tried)), 0
        for batch in batches:
            if batch.num_rows:
                owner, slots, values, soft, hard = _arrays(batch)
                total += [row_losses(_logits(w, owner, slots, values, batch.num_rows), soft, hard, temperature, alpha).sum() for w in tried]
                n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(tried)), pa.int32()), "loss": total, "n": [n] * len(tried)})

    got = rows.mapInArrow(partial, "k int, loss double, n long").groupBy("k").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect()
    by = {r.k: r.loss for r in got}
    return [by[k] for k in range(len(tried))]


def fit_student(rows: DataFrame, inputs: int, classes: int, temperature: float = 4.0, alpha: float = 0.7, rounds: int = 50, rates: Sequence[float] = RATES,
                start: Student | None = None, least: float = 1e-6) -> Student:
    """Fit on ``slots, shares, soft, hard``; a single rate is taken as it is, several are searched along the gradient.

    Stops when no rate lowers the loss by ``least`` of it. No rows leave the start.
    """
    rows = rows.select("slots", F.col("shares").cast("array<double>").alias("shares"), F.col("soft").cast("array<double>").alias("soft"), F.col("hard").cast("long").alias("hard"))
    weights = np.zeros((inputs + 1, classes)) if start is None else start.weights
    history: list[float] = []
    for _ in range(rounds):
        step, n = _gradient(rows, weights, temperature, alpha)
        if not n:
            break
        if len(rates) == 1:
            weights = weights - rates[0] * step
            continue
        tried = [weights - rate * step for rate in rates]
        now, *found = losses(rows, [weights, *tried], temperature, alpha)
        if not history:
            history.append(now)
        best = int(np.argmin(found))
        if found[best] >= now * (1 - least):
            break
        weights = tried[best]
        history.append(found[best])
        # the next search starts around the rate that was best
        rates = tuple(rates[best] * 4 / 2 ** k for k in range(len(rates)))
    return Student(weights, tuple(history))


def student_scores(df: DataFrame, student: Student) -> DataFrame:
    """Adds ``student``: the class probabilities of rows with ``slots`` and ``shares``."""
    weights = student.weights

    @F.pandas_udf("array<double>")
    def probs(slots: pd.Series, shares: pd.Series) -> pd.Series:
        z = np.stack([(weights[s] * np.asarray(v)[:, None]).sum(axis=0) + weights[-1] for s, v in zip(slots, shares, strict=True)])
        return pd.Series(list(_softmax(z)))

    return df.withColumn("student", probs("slots", "shares"))

