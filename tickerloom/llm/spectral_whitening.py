"""Whitening of embeddings along the leading components of their covariance, found by spectrum slicing (``spectrum``).

Entries become whole numbers on a grid, so that copies are equal, counts and sums are exact, and every job gives the same
components. Plan: rows are packed (two bytes an entry where they fit) and made distinct by one shuffle of the packed rows, with
a map-side part, into a stored table; one pass sums each dimension exactly, one pass sums the centred products, and after the
eigenpairs (a matter of a dimensions x dimensions matrix on the driver, no matter how many rows) one pass measures the
covariance of the whitened fit list. Partial matrices of tasks are folded row by row in Spark before the driver takes one
matrix. The rows themselves are projected where they are read, without a shuffle.

Cases: a row whose vector is NULL or holds NULL or non-finite entries, and one whose length is not the most frequent one among distinct
vectors (ties: the longer), is dropped; repeated rows and NULL ids stay; grid values beyond 62 bits saturate; ``deviation`` is
NULL where it exceeds a long; components whose variance is below 1e-12 of the first one's are left out, as rounding hides them: without
any (an empty table, one distinct vector) the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored, table
from .spectrum import leading

#: Grid steps per unit, and what is added to a grid value.
GRID, ORIGIN = 64, 1_000_000
LIMIT = 1 << 62
#: Rows of one projection step.
ROWS = 2048
PACKED = pa.schema([("size", pa.int32()), ("wide", pa.bool_()), ("packed", pa.binary())])
MATRIX = pa.schema([("i", pa.int32()), ("values", pa.list_(pa.float64()))])
OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()),
])


@dataclass(frozen=True)
class Whitening:
    """Exact sums of the grid values (less ``ORIGIN``) over ``n`` distinct vectors; eigenvalues, unit vectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, grid: np.ndarray) -> np.ndarray:
        return _centred(grid, self.n, self.sums)

    def project(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ (self.vectors / np.sqrt(self.values))


def _centred(grid: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (grid - whole).astype(float) - part


def _gridded(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and grid values (less ``ORIGIN``) of the sound vectors, one length after another."""
    sizes = np.diff(vectors.offsets.to_numpy())
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL entries: not a number
    starts = vectors.offsets.to_numpy()[:-1]
    for size in np.unique(sizes[there & (sizes > 0)]):
        rows = np.flatnonzero(there & (sizes == size))
        entries = flat[starts[rows][:, None] + np.arange(size)]
        sound = np.isfinite(entries).all(axis=1)
        low = np.floor(GRID * entries[sound])
        yield rows[sound], np.where(np.abs(low) < LIMIT, low, np.sign(low) * LIMIT).astype(np.int64)


def _binary(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(values))])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for _, grid in _gridded(batch.slice(start, ROWS).column("embedding")):
                wide = (grid != grid.astype(np.int16)).any(axis=1)
                for chosen, kind in ((~wide, np.int16), (wide, np.int64)):
                    part = grid[chosen].astype(kind)
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), part.shape[1]), pa.int32()), pa.array(np.full(len(part), kind is np.int64)), _binary(part)], schema=PACKED)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Grid values of packed rows of one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            wide = part.column("wide").to_numpy(zero_copy_only=False)
            for chosen, kind in ((~wide, np.int16), (wide, np.int64)):
                rows = part.column("packed").filter(pa.array(chosen))
                if len(rows):
                    yield np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(len(rows), -1).astype(np.int64)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[int] = []
    for grid in unpacked(batches):
        small = np.abs(grid).max() < 1 << 40  # 2048 rows of these stay within 64 bits
        add = (grid if small else grid.astype(object)).sum(axis=0)
        total = [int(a) + b for a, b in zip(add, total or [0] * grid.shape[1])]
    if total:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array([str(t) for t in total])})


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(matrix)), pa.int32()), pa.array(list(matrix), MATRIX.field("values").type)], schema=MATRIX)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, values in zip(batch.column("i").to_pylist(), batch.column("values")):
            row = values.values.to_numpy()
            sums[i] = sums[i] + row if i in sums else row
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(list(sums.values()), MATRIX.field("values").type)], schema=MATRIX)


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of matrices that are given as rows (``i, values``): only their sum reaches the driver."""
    got = parts.repartition("i").mapInArrow(_folded, parts.schema).collect()
    out = np.zeros((size, size))
    for r in got:
        out[r.i] = r["values"]
    return out


def products(fit_list: DataFrame, size: int, change) -> np.ndarray:
    """Sum over all rows of the outer product of ``change(grid)`` with itself; a last row and column hold the plain sums."""

    def partial(batches):
        total = np.zeros((size + 1, size + 1))
        for grid in unpacked(batches):
            z = change(grid)
            z = np.hstack([z, np.ones((len(z), 1))])
            total += z.T @ z
        yield _rows(total)

    return summed(fit_list.mapInArrow(partial, "i int, values array<double>"), size + 1)


def _covariance(total: np.ndarray, n: int) -> np.ndarray:
    mean = total[-1, :-1] / n
    v = total[:-1, :-1] / n - np.outer(mean, mean)
    return (v + v.T) / 2


def _vectors(vectors: DataFrame, vector: str, *more) -> DataFrame:
    return vectors.select(*more, F.col(f"`{vector}`").cast("array<double>").alias("embedding"))


def fit(vectors: DataFrame, components: int = 16, vector: str = "embedding") -> Whitening | None:
    """The whitening of the distinct sound vectors; None without any."""
    bounded_batches(vectors.sparkSession)
    packed = _vectors(vectors, vector).mapInArrow(pack, "size int, wide boolean, packed binary").distinct()
    packed = stored(packed, "fit-list")
    sizes = packed.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    size, n = sizes[0]
    fit_list = packed.where(F.col("size") == size)
    added = fit_list.mapInArrow(_exact_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = tuple(int(s) for _, s in sorted((r.i, r.s) for r in added))
    v = _covariance(products(fit_list, size, lambda grid: _centred(grid, n, sums)), n)
    values, axes = leading(v, components)
    keep = values > 1e-12 * values[0] if len(values) else np.zeros(0, bool)
    model = Whitening(n, sums, values[keep], axes[:, keep], float(np.trace(v)), 0.0)
    if not keep.any():
        return model
    white = _covariance(products(fit_list, int(keep.sum()), model.project), n)
    return Whitening(n, sums, model.values, model.vectors, model.trace, float(np.abs(white - np.eye(len(white))).max()))


def deviations(grid: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums of squares of ``n * x - S``; None beyond a long."""
    most = n * int(np.abs(grid).max()) + max(abs(s) for s in sums)
    if grid.shape[1] * most * most < 1 << 63:
        return ((n * grid - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * grid.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            for rows, grid in _gridded(part.column("embedding")):
                if grid.shape[1] != len(model.sums) or not len(grid):
                    continue
                ids = part.column("vec_id").take(pa.array(np.repeat(rows, k)))
                off = pa.array(deviations(grid, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                every = len(rows) * k
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(every, model.n), pa.int64()), off,
                    pa.array(model.project(grid).ravel()), pa.array(np.tile(model.values / model.trace, len(rows))), pa.array(np.full(every, model.identity_error)),
                ], schema=OUT)


def whitened(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per sound vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], ddl)
    rows = _vectors(vectors, vector, F.col(f"`{key}`").cast("long").alias("vec_id"))
    return rows.mapInArrow(lambda batches: _projected(batches, model), ddl)


def op11_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitened(vectors, fit(vectors))
