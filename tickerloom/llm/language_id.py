"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' byte n-grams (hashed into a fixed number of buckets). The embeddings
and the softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``sample`` rows, the smallest by a hash of their id), of which one in five is kept to calibrate the temperature and the
confidence below which a prediction is marked as rejected. Prediction is linear in the n-grams, so embedding and softmax
are folded into one row of class scores per bucket, and whole texts are summed up batch by batch.

Cases: ``und`` with score 0 where the text is NULL, empty or has no letter, and everywhere if nothing could be learned
(no labelled row with a letter); ties go to the language that sorts first; rows and ids may repeat; clashing or extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, coded, fold, joined_bytes, keyed, ngram_buckets, out_batch, split_words, steps, table

SIZES = (1, 2, 3, 4)
#: Bytes of texts worked on at once; a byte of a distinct word takes some fifty bytes of working arrays.
STEP = 6 << 20
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()),
])


def bucket_sums(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets and how often each occurs."""
    words, rows = split_words(texts)
    ids, distinct = coded(words)
    sizes = list(ngram_buckets(*joined_bytes(distinct), SIZES, buckets))
    owner, bucket = (np.concatenate([s[k] for s in sizes] or [np.zeros(0, np.int64)]) for k in (0, 1))
    order = np.argsort(owner, kind="stable")
    bucket, edges = bucket[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        mine, n = np.unique(ids[starts[i]:starts[i + 1]], return_counts=True)
        lengths = edges[mine + 1] - edges[mine]
        at = np.repeat(edges[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        total = np.bincount(bucket[at], weights=np.repeat(n, lengths), minlength=0) if len(at) else np.zeros(0)
        some = np.flatnonzero(total)
        yield some, total[some]


def sums_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.binary()), ("n", pa.binary())])
    for batch in steps(batches, limit=STEP):
        found = list(bucket_sums(batch.column("text"), buckets))
        yield out_batch(schema, lang=batch.column("lang"), bucket=[b.astype(np.int32).tobytes() for b, _ in found], n=[n.astype(np.float32).tobytes() for _, n in found])


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    floor: float  # of the confidence of accepted predictions


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, size: int = 16, epochs: int = 12, rate: float = 20.0,
    precision: float = 0.995, seed: int = 7,
) -> LanguageModel | None:
    rows = [(lang, b, n / n.sum()) for lang, b, n in rows if len(b)]
    langs = tuple(sorted({lang for lang, _, _ in rows}))
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([langs.index(lang) for lang, _, _ in rows])
    order = rng.permutation(len(rows))
    keep = order[: len(rows) // 5] if len(rows) >= 50 else order
    fit = order[len(rows) // 5:] if len(rows) >= 50 else order
    embed = rng.normal(0, 1 / size, (buckets, size)).astype(np.float32)
    soft, bias = np.zeros((size, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    averages = lambda part: np.stack([rows[i][2] @ embed[rows[i][1]] for i in part])
    done, total = 0, epochs * len(fit)
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), 16):
            part = fit[at:at + 16]
            h = averages(part)
            g = softmax(h @ soft + bias)
            g[np.arange(len(part)), label[part]] -= 1
            step = rate * (1 - done / total) / len(part)
            back = g @ soft.T
            soft -= step * 0.05 * (h.T @ g)
            bias -= step * 0.01 * g.sum(axis=0)
            for j, i in enumerate(part):
                embed[rows[i][1]] -= step * rows[i][2][:, None] * back[j]
            done += len(part)
    z = averages(keep) @ soft + bias
    grid = np.geomspace(0.2, 20, 40)
    loss = [-np.log(softmax(z / t)[np.arange(len(keep)), label[keep]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == label[keep]
    rank = np.argsort(-sure, kind="stable")
    good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(rank) + 1) >= precision)
    floor = float(sure[rank[good[-1]]]) if len(good) else 1.0
    return LanguageModel(langs, embed @ soft, bias, temperature, floor)


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = 2000, buckets: int = 1 << 15) -> LanguageModel | None:
    """Train on at most ``sample`` labelled rows; the driver gets at most ``buckets`` numbers for each."""
    bounded_batches(rows.sparkSession)
    own = keyed(rows, key, text, F.col(f"`{lang}`").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    ids = own.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    picked = own.join(F.broadcast(ids), "doc_id").select("text", "lang")  # at most ``sample`` ids; the texts stay where they are
    got = picked.mapInArrow(lambda it: sums_batches(it, buckets), "lang string, bucket binary, n binary").collect()
    return train(sorted(((r.lang, np.frombuffer(r.bucket, np.int32), np.frombuffer(r.n, np.float32)) for r in got), key=lambda r: (r[0], len(r[1]), float(r[2].sum()))), buckets)


def predict_batches(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, limit=STEP):
        n = batch.num_rows
        lang, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
        if model is not None:
            words, rows = split_words(batch.column("text"))
            ids, distinct = coded(words)
            pieces, of_word = np.zeros(len(distinct)), np.zeros((len(model.langs), len(distinct)))
            for owner, bucket in ngram_buckets(*joined_bytes(distinct), SIZES, len(model.scores)):
                pieces += np.bincount(owner, minlength=len(distinct))
                for k in range(len(model.langs)):
                    of_word[k] += np.bincount(owner, weights=model.scores[bucket, k], minlength=len(distinct))
            count = np.maximum(np.bincount(rows, weights=pieces[ids], minlength=n), 1)
            z = np.stack([np.bincount(rows, weights=w[ids], minlength=n) / count + b for w, b in zip(of_word, model.bias, strict=True)], axis=1)
            p = softmax(z / model.temperature)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(axis=1)
            lang[letters] = np.array(model.langs, object)[best[letters]]
            score[letters] = p.max(axis=1)[letters]
            accepted = letters & (score >= model.floor)
        yield out_batch(SCHEMA, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=lang, score=score, accepted=accepted)


def identify(docs: DataFrame, model: LanguageModel | None, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every row; ``held_out``: a column to carry along."""
    bounded_batches(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    own = keyed(docs, key, text, held_out.alias("held_out")).select("doc_id", "text", "held_out", letters)
    return own.mapInArrow(lambda it: predict_batches(it, model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, model, fold("doc_id", 5) == 0)
