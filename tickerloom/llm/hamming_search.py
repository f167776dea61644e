"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred and rotated so that the signs of their coordinates lose little (iterative quantisation, fitted on at
most ``sample`` rows; several rotations are laid side by side for longer codes). A code is cut into byte substrings and
every substring is indexed. If two codes differ in at most ``r`` bits, some substring differs in at most ``r // m`` of its
bits (and the budget may be one lower for all substrings beyond the first ``r % m + 1``), so probing all byte values that
near in every substring retrieves each code within the radius. These are reranked by the cosine of the original vectors in
double precision.

The radius is measured, not guessed: it holds ``cover`` of the true neighbours of sample rows among the sample (in all
rows neighbours are nearer). The index is sharded into blocks of bounded size, each query block meets every shard once,
and only each shard's ``k`` best leave it. A query with too few results within the radius is searched again with the
radius opened to the whole code length.

Cases: vectors that are NULL, zero, hold NULL or non-finite components, or have another length than most of the sample
take no part, nor do rows without an id; ties go to the smaller id; an id that occurs twice is two candidates (its own other row is not one); fewer
candidates than ``k`` give fewer rows; an empty table gives an empty result; clashing or extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

#: Rows of an index shard and of a query block.
SHARD, QUERIES = 8192, 2048
OUT = "query_id long, vec_id long, score double"
SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    planes: np.ndarray  # dimensions x bits
    radius: int

    @property
    def bits(self) -> int:
        return self.planes.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.planes > 0, axis=1)


def learn(x: np.ndarray, k: int, cover: float, rotations: int = 2, rounds: int = 30) -> Codes:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    dim = x.shape[1]
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    flat = (x - mean) @ axes
    planes = []
    for seed in range(rotations):
        rot = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ rot > 0, 1.0, -1.0).T @ flat)
            rot = (u @ vt).T
        planes.append(axes @ rot)
    planes = np.concatenate(planes, axis=1)
    planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))
    codes = Codes(mean, planes, 0)
    b = codes.encode(x)
    some = np.arange(min(len(x), 200))
    far = []
    for i in some:
        near = x @ x[i]
        near[i] = -2
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        far += BITS[b[best] ^ b[i]].sum(axis=1).tolist()
    return Codes(mean, planes, int(np.quantile(far, cover)) if far else codes.bits)


class Shard:
    """All substrings of a block of codes, each as an inverted list over byte values."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits."""
        m = len(code)
        budget, spare = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = budget if j <= spare else budget - 1
            if reach < 0:
                continue
            values = np.flatnonzero(BITS[np.arange(256) ^ code[j]] <= reach)
            lo, hi = self.start[j][values], self.start[j][values + 1]
            lengths = hi - lo
            at = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            hit[self.order[j][at]] = True
        rows = np.flatnonzero(hit)
        return rows[BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search_shard(rows: pa.Table, queries: pa.Table, codes: Codes, k: int, whole: bool) -> pa.Table:
    if not rows.num_rows or not queries.num_rows:
        return SCHEMA.empty_table()
    x, q = _matrix(rows.column("embedding")), _matrix(queries.column("embedding"))
    ids, asked = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    shard = Shard(codes.encode(x / nx[:, None]))
    code = codes.encode(q / nq[:, None])
    out = []
    for i in range(len(q)):
        some = shard.within(code[i], codes.bits if whole else codes.radius)
        some = some[ids[some] != asked[i]]
        rough = (x[some] @ q[i]) / nx[some]
        if len(some) > k:
            some = some[rough >= np.partition(rough, -k)[-k] - 1e-9 * nq[i]]
        score = (x[some] * q[i]).sum(axis=1) / (nx[some] * nq[i])
        best = np.lexsort((ids[some], -score))[:k]
        out.append(pa.table([np.full(len(best), asked[i]), ids[some][best], score[best]], schema=SCHEMA))
    return pa.concat_tables(out)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = 8000, cover: float = 0.985) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each row for which ``asked`` (over ``vec_id``) holds."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    got = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not got:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(len(r.embedding) for r in got).most_common(1)[0][0]
    codes = learn(np.array([r.embedding for r in got if len(r.embedding) == dim]), k, cover)
    own = own.where(F.size("embedding") == dim)
    n, n_asked = own.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    shards, groups = max(1, -(-n // SHARD)), max(1, -(-n_asked // QUERIES))
    mark = F.xxhash64("vec_id", F.lit(5))

    def searched(queries: DataFrame, whole: bool) -> DataFrame:
        left = own.select("*", F.pmod(mark, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        right = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(mark, F.lit(groups)).alias("group"))
        left, right = (d.select("vec_id", "embedding", F.col("shard").cast("long"), F.col("group").cast("long")) for d in (left, right))
        met = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group"))
        return met.applyInArrow(lambda a, b: search_shard(a, b, codes, k, whole), OUT)

    queries = own.where(asked)
    found = stored(searched(queries, False), "hamming")
    short = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = stored(queries.join(short, queries["vec_id"] == short["query_id"], "left_anti"), "hamming-short")
    if short.limit(1).count():
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(searched(short, True))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
