"""Helpers shared by the text operators: whole-text batches, word splitting, seeded folds, shared tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of text that one Python step works on; a single longer text is a step of its own.
STEP_BYTES = 6 << 20
#: Bytes of text that decisions on whole rows are made for at once: their batch, with all its columns, stays in memory beside it.
KEPT_BYTES = 1 << 20
#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20
#: Whether Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(key: str | Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a NULL key counts as empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text), F.lit(parts)).cast("int")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Compute once into a table under ``spark.checkpoint.dir`` and read it back.

    The folder is shared by all executors, so the table survives the loss of those that wrote it. Shuffle files go once it is written.
    """
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        return materialize(df, purpose)
    finally:
        conf.set(SHUFFLES_GO, before)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored``, once all that was read from it is stored itself."""
    jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _heap():
    """The C library's ``malloc_trim``, where there is one; arrays of a megabyte and more then come straight from the system."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; set once, it no longer grows with what has been freed
        return libc.malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def release(trim=[]) -> None:  # noqa: B006  one handle per worker
    """Give back what the last step has freed: Spark uses its Python workers again, and they would keep it."""
    if not trim:
        trim.append(_heap())
    pa.default_memory_pool().release_unused()
    trim[0](0)


def release_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect garbage, after which they give heap back that earlier work has grown.

    A JVM keeps what it once took, and Python workers need room beside it. One short task per core, so that every executor gets some.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each piece stay within ``limit`` bytes; NULL texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, pa.field(column, pa.string()), batch.column(at).cast(pa.string()).fill_null(""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            release()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after another, and the row of each word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), lengths)
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py():
        flat, rows = flat.filter(keep), rows[keep.to_numpy(zero_copy_only=False)]
    return flat, rows


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word among the distinct words, and these."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def joined_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words laid end to end, and the start of each word (one more at the end)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def ngram_buckets(raw: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed byte n-grams of every word (with ``<`` and ``>`` around it): (word index, bucket), one size after another."""
    n = len(starts) - 1
    lengths = np.diff(starts) + 2
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if n else 0
    padded = np.empty(total, np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    inner = np.ones(total, bool)
    inner[ends - lengths] = False
    inner[ends - 1] = False
    padded[ends - lengths], padded[ends - 1] = 60, 62
    padded[inner] = raw
    for size in sizes:
        if total < size:
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(total - size + 1, np.uint64)
            for k in range(size):
                h = h * np.uint64(257) + padded[k:total - size + 1 + k]
            same = owner[:total - size + 1] == owner[size - 1:]
        yield owner[:total - size + 1][same], (mixed(h[same], size) % np.uint64(buckets)).astype(np.int64)


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema,
    )


def keyed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """Only what an operator reads, under fixed names, whatever else the table has."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *more)


def _kept_batches(batches: Iterator[pa.RecordBatch], column: str, decide) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        keep = [decide(part.column(column)) for part in steps(iter([whole.select([column])]), column, KEPT_BYTES)]
        if keep:
            yield whole.filter(pa.array(np.concatenate(keep)))


def kept(docs: DataFrame, column: str, decide) -> DataFrame:
    """The rows, with all their columns, for whose texts ``decide`` (texts of a step -> booleans) holds; no shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _kept_batches(it, column, decide), docs.schema)
