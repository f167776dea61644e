"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear support vector machine.

Features of a whole text are indicators: its distinct words, and its one- and two-word *shape* grams (letters, digits and
marks by kind, runs shortened) each with the share of the text that it covers, in powers of two; repeated neighbours and
repeated lines count as shapes too. Every indicator is scaled by the log ratio of its smoothed rates in the two classes; a hinge loss
with squared norm is fitted by dual coordinate descent. The margin becomes a probability by a sigmoid fitted on rows the
machine has not seen (one in five of the sample).

Labels are learned from at most ``sample`` rows (smallest by a hash of their id).

Cases: NULL and empty texts have no indicator and get the score of the bias; NULL labels are left out; a document labelled
twice counts with its smallest label; with one class or no label every score is the rate of label 1 (1 if there is none);
rows and ids may repeat; clashing or extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, coded, fold, kept, keyed, mixed, out_batch, split_words, steps, table, word_hashes

BUCKETS = 1 << 18
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def shapes(words: pa.Array) -> pa.Array:
    """Kind of each word: runs of small letters, capitals, digits and other marks, each run as one or two signs."""
    s = pc.replace_substring_regex(words, r"[a-z\x{80}-\x{10FFFF}]+", "a")
    s = pc.replace_substring_regex(s, r"[A-Z]([A-Z])+", "AA")
    s = pc.replace_substring_regex(s, r"[0-9]+", "0")
    s = pc.replace_substring_regex(s, r"([!?.,;:#$%&*=_~+|-])[!?.,;:#$%&*=_~+|-]+", r"\1\1")
    return s


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of all texts, ordered."""
    words, rows = split_words(texts, lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, distinct = coded(words)
    kind_ids, kinds = coded(shapes(distinct))
    low_ids, low = coded(pc.ascii_lower(distinct))
    kind_hash, low_hash = word_hashes(kinds), word_hashes(low)
    total = np.bincount(rows, minlength=len(texts))
    shift = np.uint64(BUCKETS - 1)

    def shared(row: np.ndarray, code: np.ndarray, seed: int) -> np.ndarray:
        """Keys (row, hash of code and of the power of two of its share)."""
        if not len(row):
            return np.zeros(0, np.int64)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1]))))
        n = np.diff(np.concatenate((head, [len(row)])))
        share = np.floor(np.log2(n / total[row[head]])).astype(np.int64)
        with np.errstate(over="ignore"):
            h = mixed(code[head] + np.uint64(1000003) * share.astype(np.uint64), seed)
        return row[head] * BUCKETS + (h & shift).astype(np.int64)

    kind = kind_hash[kind_ids[ids]]
    small = low_ids[ids]
    next_to = rows[1:] == rows[:-1]
    same = next_to & (small[1:] == small[:-1])
    with np.errstate(over="ignore"):
        pair = mixed(kind[:-1], 5) + kind[1:]
    lines = _repeated_lines(texts)
    keys = [
        np.unique(rows * BUCKETS + (mixed(low_hash, 1)[small] & shift).astype(np.int64)),
        shared(rows, kind, 2),
        shared(rows[1:][next_to], pair[next_to], 3),
        shared(rows[1:][same], np.full(int(same.sum()), 1, np.uint64), 4),
        np.flatnonzero(lines) * BUCKETS + (mixed(lines[lines > 0].astype(np.uint64), 6) & shift).astype(np.int64),
    ]
    keys = np.unique(np.concatenate(keys))
    return keys // BUCKETS, keys % BUCKETS


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """1 + the eighth of its lines that repeat an earlier line, for texts of two lines or more; else 0."""
    split = pc.split_pattern(texts, "\n")
    n = np.diff(split.offsets.to_numpy())
    ids, _ = coded(split.flatten())
    rows = np.repeat(np.arange(len(texts)), n)
    fresh = np.bincount(np.unique(rows * (int(ids.max(initial=0)) + 1) + ids) // (int(ids.max(initial=0)) + 1), minlength=len(texts))
    return np.where(n > 1, 1 + (8 * (n - fresh)) // np.maximum(n, 1), 0)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of buckets, log-count ratio included
    bias: float
    slope: float
    offset: float


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Weights of a linear machine with hinge loss: one dual variable at a time, in shuffled order. The last weight is the bias."""
    w = np.zeros(len(scale))
    alpha = np.zeros(len(rows))
    norms = np.array([float(np.sum(scale[r] ** 2)) for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] <= 0:
                continue
            r = rows[i]
            g = sign[i] * float(w[r] @ scale[r]) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * sign[i] * scale[r]
                most = max(most, abs(new - alpha[i]) * norms[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def train(rows: list[tuple[int, np.ndarray]], cost: float = 0.05, smooth: float = 1.0) -> QualityModel:
    y = np.array([label for label, _ in rows], float)
    if not len(rows) or y.min() == y.max():
        rate = float(y.mean()) if len(rows) else 1.0
        return QualityModel(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    kept = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)

    def fitted(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [np.append(rows[i][1], BUCKETS) for i in part]
        count = np.zeros((2, BUCKETS + 1))
        for i, r in zip(part, some, strict=True):
            count[int(y[i]), r] += 1
        p, q = count[1] + smooth, count[0] + smooth
        ratio = np.log(p / (y[part].sum() + 2 * smooth)) - np.log(q / ((1 - y[part]).sum() + 2 * smooth))
        ratio[BUCKETS] = 1.0
        sign = 2 * y[part] - 1
        ones = y[part].mean()
        weight = dual_descent(some, ratio, sign, cost * np.where(sign > 0, 0.5 / ones, 0.5 / (1 - ones)))
        return weight * ratio, ratio

    w, _ = fitted(np.flatnonzero(~kept))
    check = np.flatnonzero(kept) if kept.any() and 0 < y[kept].mean() < 1 else np.arange(len(rows))
    margin = np.array([w[rows[i][1]].sum() + w[BUCKETS] for i in check])
    slope, offset = _sigmoid(margin, y[check])
    return QualityModel(w[:BUCKETS], float(w[BUCKETS]), slope, offset)


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the log loss with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * np.array([a - 1, 0.0]))
        size = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def _indicator_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary())])
    for batch in steps(batches):
        rows, bucket = indicators(batch.column("text"))
        cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        yield out_batch(schema, doc_id=batch.column("doc_id"), label=batch.column("label"), bucket=[bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 6000) -> QualityModel:
    """Train on at most ``sample`` labelled documents; the driver gets their distinct buckets."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = keyed(docs, key, text).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "label")  # at most ``sample`` rows
    got = own.mapInArrow(_indicator_batches, "doc_id long, label int, bucket binary").collect()
    return train([(r.label, np.frombuffer(r.bucket, np.int32)) for r in sorted(got, key=lambda r: (r.doc_id, r.label, len(r.bucket)))])


def scores_of(texts: pa.Array, model: QualityModel) -> np.ndarray:
    rows, bucket = indicators(texts)
    margin = np.bincount(rows, weights=model.weights[bucket], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def _score_batches(batches: Iterator[pa.RecordBatch], model: QualityModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        score = scores_of(batch.column("text"), model)
        yield out_batch(SCHEMA, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=score, predicted=(score >= threshold).astype(np.int32))


def score_quality(
    docs: DataFrame, model: QualityModel, held_out: Column, threshold: float = 0.3, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    bounded_batches(docs.sparkSession)
    own = keyed(docs, key, text, held_out.alias("held_out"))
    return own.mapInArrow(lambda it: _score_batches(it, model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    return kept(docs, text, lambda texts: scores_of(texts, model) >= threshold)


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return fit(docs, labels.where(fold("doc_id", 5) != 0))


def op8_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_folds(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, fold("doc_id", 5) == 0)
