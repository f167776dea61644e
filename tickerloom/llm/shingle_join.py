"""N-gram Jaccard join with several global orders.

A document is the set of its word shingles. Two sets of Jaccard similarity at least t must share a token among the first few
of each (the prefix) under *any* one global order of all tokens, so a pair is a candidate only if it shares prefix tokens
under several orders. The orders put rare tokens first: how often a token occurs comes from a counting sketch of fixed size
over all documents; ties are broken by a different hash per order. The first order finds candidates, the others filter them
before the sets are fetched and compared exactly.

Copies (equal sets) are one node. Candidates with a common prefix token are gathered into flocks: documents of a token that
few share are paired where their sizes and the token's places allow the similarity; those of a token that many share are
all tied to one of them. The components of these ties hold every linked pair. Within a flock the sets are compared in
memory, through an index of the prefixes under all orders; a large flock is cut into blocks, and each pair of blocks is one
group. Pairs that are connected already are skipped, so components lose no link, and a group of copies with small edits costs
about one comparison each.

Cases: NULL and empty texts have an empty set and are linked with nothing; texts shorter than a shingle are one shingle;
equal rows are copies; rows without an id are given back unlinked; an id that occurs twice is one document, with its rows' sets
compared each (the first row by set stands for it) - ids should be unique; clashing or extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, coded, discard, keyed, mixed, out_batch, split_words, steps, stored, table, word_hashes
from .components import components

#: Counters of the sketch, of one of its pieces, and largest count of a task kept.
CELLS, PIECE, MOST = 1 << 24, 1 << 16, 65535
ORDERS = 3
#: Documents of a block of a large flock, and bytes of their sets; documents that share a token and are still paired one by one.
BLOCK, BLOCK_BYTES, HOT = 512, 4 << 20, 64
#: Bytes of texts worked on at once; a word takes about a hundred bytes of working arrays.
STEP = 2 << 20
#: Candidate ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, rows = split_words(texts)
    sizes = np.bincount(rows, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    ids, distinct = coded(words)
    h = word_hashes(distinct)[ids]
    del words, ids, distinct
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):  # beyond the end of its text a shingle is not used, or is the short text as a whole
            out[:len(h) - k] += h[k:] * np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) & 0x7FFFFFFFFFFFFFFF) + 1)
        for i in np.flatnonzero((sizes > 0) & (sizes < n)):
            own = h[starts[i]:starts[i] + sizes[i]]
            out[starts[i]] = np.uint64(sizes[i])
            for k in range(len(own)):
                out[starts[i]] += own[k] * np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) & 0x7FFFFFFFFFFFFFFF) + 1)
    out = mixed(out)
    sets = []
    for lo, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        own = np.sort(out[lo:lo + (max(1, size - n + 1) if size else 0)])
        sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if size else own)
    return sets


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in steps(batches, limit=STEP):
        yield batch, shingle_sets(batch.column("text"), n)


def outline_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each document the size and a 128-bit mark of its set; of each task the sketch of its tokens, in packed pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark1", pa.int64()), ("mark2", pa.int64()), ("piece", pa.int32()), ("data", pa.binary())])
    sketch = np.zeros(CELLS, np.uint16)
    for batch, sets in _sets(batches, n):
        tokens = np.concatenate(sets)
        cut = np.cumsum([0, *map(len, sets)])
        cell, times = np.unique((mixed(tokens, 50) & np.uint64(CELLS - 1)).astype(np.int32), return_counts=True)
        sketch[cell] = np.minimum(sketch[cell] + times, MOST)
        marks = []
        with np.errstate(over="ignore"):
            for seed in (60, 61):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens, seed), dtype=np.uint64)))
                marks.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
        size = batch.num_rows
        yield out_batch(
            schema, doc_id=batch.column("doc_id"), n=np.diff(cut), mark1=marks[0], mark2=marks[1], piece=pa.nulls(size, pa.int32()), data=pa.nulls(size, pa.binary()),
        )
    pieces = sketch.reshape(-1, PIECE)
    some = np.flatnonzero(pieces.any(axis=1))
    pack = zstandard.ZstdCompressor(level=1)
    none = pa.nulls(len(some), pa.int64())
    yield out_batch(schema, doc_id=none, n=none, mark1=none, mark2=none, piece=some.astype(np.int32), data=[pack.compress(pieces[i].tobytes()) for i in some])


def _summed(rows: pa.Table) -> pa.Table:
    unpack, total = zstandard.ZstdDecompressor(), np.zeros(PIECE, np.int64)
    for data in rows.column("data").to_pylist():
        total += np.frombuffer(unpack.decompress(data), np.uint16)
    # the order needs powers of two only
    level = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"piece": rows.column("piece").slice(0, 1), "data": [zstandard.compress(level.tobytes(), 1)]})


class Order:
    """Global orders of tokens: level in the sketch, then a hash that differs by order."""

    def __init__(self, levels: np.ndarray):
        self.levels = levels

    def ranks(self, tokens: np.ndarray, k: int) -> np.ndarray:
        level = self.levels[(mixed(tokens, 50) & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
        return (level << np.uint64(58)) | (mixed(tokens, 70 + k) >> np.uint64(6))


def least_common(a, b, t: Fraction):
    """Least intersection of sets of sizes ``a`` and ``b`` of similarity ``t``: ceil(t (a + b) / (1 + t))."""
    return -(-(t.numerator * (a + b)) // (t.numerator + t.denominator))


def prefix_length(n, t: Fraction):
    return n - -(-(t.numerator * n) // t.denominator) + 1


def prefix_batches(batches: Iterator[pa.RecordBatch], n: int, t: Fraction, order) -> Iterator[pa.RecordBatch]:
    """Of each document the size, the prefix under the first order, and short codes of those under the others."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), *[(f"codes{k}", pa.list_(pa.int32())) for k in range(1, ORDERS)]])
    for batch, sets in _sets(batches, n):
        lists = {}
        for k in range(ORDERS):
            prefixes = [prefix_of(order.value, own, k, t) for own in sets]
            flat = np.concatenate(prefixes)
            flat = (flat >> np.uint64(20)).astype(np.uint32).view(np.int32) if k else flat.view(np.int64)
            lists[f"codes{k}" if k else "prefix"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(flat))
        yield out_batch(schema, doc_id=batch.column("doc_id"), n=np.array([len(own) for own in sets], np.int64), **lists)


def prefix_of(order: Order, tokens: np.ndarray, k: int, t: Fraction) -> np.ndarray:
    """The first tokens of a set under order ``k``, as ranks."""
    if not len(tokens):
        return tokens
    take = prefix_length(len(tokens), t)
    return np.sort(np.partition(order.ranks(tokens, k), take - 1)[:take])


def set_batches(batches: Iterator[pa.RecordBatch], n: int, t: Fraction, order) -> Iterator[pa.RecordBatch]:
    """Of each document its sorted set and its prefixes under all orders, packed, and where it belongs."""
    places = ("component", "block", "blocks")
    schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("tokens", pa.binary()), ("prefixes", pa.binary())])
    for batch, sets in _sets(batches, n):
        prefixes = [b"".join(prefix_of(order.value, own, k, t).tobytes() for k in range(ORDERS)) for own in sets]
        yield out_batch(
            schema, doc_id=batch.column("doc_id"), **{c: batch.column(c) for c in places}, tokens=[own.tobytes() for own in sets], prefixes=prefixes,
        )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


class Sets:
    """Some documents' sets and prefixes, unpacked."""

    def __init__(self, tokens, prefixes):
        self.tokens = [np.frombuffer(v.as_buffer(), np.uint64) for v in tokens]
        self.prefixes = [np.frombuffer(v.as_buffer(), np.uint64).reshape(ORDERS, -1) for v in prefixes]

    def linked(self, i: int, other: Sets, j: int, t: Fraction) -> bool:
        """Whether two sets share prefix tokens under every order and are similar enough."""
        x, y = self.tokens[i], other.tokens[j]
        need = least_common(len(x), len(y), t)
        if need > min(len(x), len(y)) or not all(_common(self.prefixes[i][k], other.prefixes[j][k]) for k in range(ORDERS)):
            return False
        return _common(x, y) >= need


def compared(rows: pa.Table, t: Fraction) -> pa.Table:
    """Links that connect the documents of one or two blocks, found through an index of their prefix tokens.

    Documents connected by a link found here are not compared again.
    """
    rows = rows.combine_chunks().sort_by("doc_id")
    ids, block = rows.column("doc_id").to_pylist(), rows.column("block").to_pylist()
    crossed = rows.num_rows > 0 and rows.column("one")[0] != rows.column("two")[0]
    sets = Sets(rows.column("tokens"), rows.column("prefixes"))
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    postings: dict[int, list[int]] = {}
    a, b = [], []
    for i in range(len(ids)):
        tokens = sets.prefixes[i][0].tolist() if len(sets.prefixes[i][0]) else []
        for j in sorted(set().union(*[postings.get(x, ()) for x in tokens])):
            if (crossed and block[i] == block[j]) or find(i) == find(j):
                continue
            if sets.linked(i, sets, j, t):
                a.append(ids[j])
                b.append(ids[i])
                root[find(i)] = find(j)
        for x in tokens:
            postings.setdefault(x, []).append(i)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class JaccardJoin:
    """Links between documents whose shingle sets have a Jaccard similarity of at least ``t``."""

    def __init__(self, docs: DataFrame, t: Fraction, shingle: int, key: str = "doc_id", text: str = "text"):
        self.spark, self.t, self.shingle = docs.sparkSession, t, shingle
        bounded_batches(self.spark)
        self.docs = keyed(docs, key, text)
        outline = stored(self.docs.mapInArrow(
            lambda it: outline_batches(it, shingle), "doc_id long, n long, mark1 long, mark2 long, piece int, data binary",
        ), "shingle-outline")
        self.outline = stored(outline.where("piece IS NULL").select("doc_id", "n", "mark1", "mark2"), "shingle-marks")
        pieces = outline.where("piece IS NOT NULL").select("piece", "data").groupBy("piece").applyInArrow(_summed, "piece int, data binary")
        pieces = stored(pieces, "shingle-levels")
        levels = np.zeros((CELLS // PIECE, PIECE), np.uint8)
        unpack = zstandard.ZstdDecompressor()
        for r in pieces.collect():
            levels[r.piece] = np.frombuffer(unpack.decompress(bytes(r.data)), np.uint8)
        discard(pieces)
        discard(outline)
        self.order = self.spark.sparkContext.broadcast(Order(levels.ravel()))  # of fixed size
        named = self.outline.where("doc_id IS NOT NULL AND n > 0")
        members = named.groupBy("n", "mark1", "mark2").agg(F.min("doc_id").alias("node")).join(named, ["n", "mark1", "mark2"])
        self.members = stored(members.select("doc_id", "node", "n"), "shingle-members")

    def links(self) -> DataFrame:
        """``a, b``: enough links between different sets to connect all that are connected by links.

        What a step leaves is stored, and goes once the next one is done, so that few of them share the disk.
        """
        t, order, shingle = self.t, self.order, self.shingle
        copies = self.members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("node")).alias("own")).where("NOT own").select("doc_id")
        codes = [f"codes{k}" for k in range(1, ORDERS)]
        columns = ", ".join(["doc_id long, n long, prefix array<long>", *[f"{c} array<int>" for c in codes]])
        prefix = self.docs.where("doc_id IS NOT NULL").mapInArrow(lambda it: prefix_batches(it, shingle, t, order), columns)
        prefix = stored(prefix.where("n > 0").join(self._small(copies), "doc_id", "left_anti"), "shingle-prefixes")
        own = prefix.select("doc_id", "n", F.posexplode("prefix").alias("place", "token"))
        # rows are shuffled once: a window takes both how many have the token and the first of them
        held = Window.partitionBy("token").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        shared = own.select("token", "doc_id", "n", "place", F.count("*").over(held).alias("k"), F.first("doc_id").over(held).alias("leader"))
        shared = stored(shared.where("k > 1"), "shingle-shared")
        near = shared.where(f"k > {HOT}").where("leader <> doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
        near = stored(near.distinct(), "shingle-near")
        cold = shared.where(f"k <= {HOT}").select("token", "doc_id", "n", "place")
        x, y = cold.alias("x"), cold.alias("y")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & self._possible())
        pairs = stored(pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "shingle-pairs")
        discard(shared)
        for c in codes:  # what each of the other orders says about both documents
            met, last = pairs, pairs
            for end in "ab":
                met = met.join(prefix.select(F.col("doc_id").alias(end), F.col(c).alias(f"{c}{end}")), end)
            pairs = stored(met.where(F.arrays_overlap(f"{c}a", f"{c}b")).select("a", "b"), "shingle-pairs")
            discard(last)
        discard(prefix)
        flock = stored(components(near.union(pairs)), "shingle-flocks")
        discard(near)
        discard(pairs)

        sized = flock.join(self.members.where("doc_id = node").select("node", "n").distinct(), "node")
        # a set takes eight bytes a token, its prefixes as much at most
        blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 16 / BLOCK_BYTES)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = stored(flock.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", block.alias("block"), "blocks"), "shingle-blocks")
        sets = self.docs.join(self._small(dealt), "doc_id").mapInArrow(
            lambda it: set_batches(it, shingle, t, order), "doc_id long, component long, block int, blocks int, tokens binary, prefixes binary",
        )
        met = sets.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
            "doc_id", "tokens", "prefixes", "component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block",
        )
        return met.groupBy("component", "one", "two").applyInArrow(lambda table: compared(table, t), "a long, b long")

    def _small(self, ids: DataFrame) -> DataFrame:
        """Marked for a broadcast if its rows are counted and few."""
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    def _possible(self) -> Column:
        """Sizes allow the similarity, and so does what stands before and after the common token in both orders."""
        up, down = self.t.numerator, self.t.denominator
        most = "least(x.place, y.place) + least(x.n - x.place, y.n - y.place)"
        return F.expr(
            f"least(x.n, y.n) * {down} >= greatest(x.n, y.n) * {up} AND ({most}) * {up + down} >= {up} * (x.n + y.n)",
        )

    def joined(self) -> DataFrame:
        """``doc_id, n_shingles, component_id`` of every row."""
        part = components(self.links())
        of = self.members.join(part, self.members["node"] == part["node"], "left").select(
            "doc_id", F.coalesce("component", self.members["node"]).alias("component"),
        ).groupBy("doc_id").agg(F.min("component").alias("component"))
        rows = self.outline.select("doc_id", F.col("n").alias("n_shingles"))
        found = rows.join(of, "doc_id", "left")
        return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, t: Fraction = Fraction(9, 10), shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    return JaccardJoin(docs, t, shingle, key, text).joined()


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
