"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

The items are the indexed documents; every passage of every text is a query (passages are twice as long as the longest
item and start an item's length apart, so that each copy of an item lies in one passage as a whole). BM25 weights are
divided by the item's own total, which makes one threshold fit all items. All items that reach it are retrieved and then
verified: enough word ``n``-grams of the item's question and of its answer must stand in the passage (an item's last
sentence is its answer; an item of one sentence is cut in the middle).

A passage is searched only if some item can reach the threshold with it: per item, the lightest words are set aside as long
as they stay below a part (``light``) of the threshold together; the weights of the others in the passage and the total of
those set aside bound the score. This skips most passages and no result.

The index is sent to the tasks in blocks of items of about ``BLOCK_CHARS`` characters; more items make more passes. Word weights,
mean and longest length are those of all items, so that results do not depend on the blocks.

Cases: NULL or empty texts and items match nothing; an item without a word is left out; an item
without an id gets one below zero, made of its text; items that are equal are each
reported; a repeated document row is reported once per (doc_id, item_id); a NULL doc_id is kept as NULL; clashing or extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept, keyed, out_batch, steps, stored, table
from .license_scan import words_in

BLOCK_CHARS = 8 << 20
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("bm25", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()),
])


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for w in map(words_in, re.split(r"[.!?\n]+", text)) if w]
    words = [w for p in parts for w in p]
    if len(parts) > 1 and len(words) > len(parts[-1]):
        cut = len(words) - len(parts[-1])
    else:
        cut = (len(words) + 1) // 2
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Statistics:
    """Of all test items, whatever block they are in: their number, words, the longest one's words, and each word's items."""

    items: int
    words: int
    longest: int
    holders: dict[bytes, int]


class BlockMaxIndex:
    """Postings of items with BM25 weights as shares of each item's total, in blocks with their largest weight."""

    def __init__(
        self, items: list[tuple[int, str]], threshold: float, n: int = 3, block: int = 16, light: float = 0.5, k1: float = 1.2, b: float = 0.75,
        whole: Statistics | None = None,
    ):
        self.threshold, self.block = threshold, block
        split = [(i, *question_and_answer(t)) for i, t in items]
        split = sorted(((i, q, a) for i, q, a in split if q), key=lambda x: x[0])
        self.ids = [i for i, _, _ in split]
        self.parts = [(grams(q, n), grams(a, n)) for _, q, a in split]
        counts = [Counter(q + a) for _, q, a in split]
        lengths = [sum(c.values()) for c in counts]
        whole = whole or Statistics(len(split), sum(lengths), max(lengths, default=1), Counter(w for c in counts for w in c))
        holders, mean = whole.holders, whole.words / max(1, whole.items)
        self.terms = {w: k for k, w in enumerate(sorted({w for c in counts for w in c}))}
        self.longest = whole.longest
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        essential: list[tuple[int, int, float]] = []
        self.aside = np.zeros(len(split))
        for d, c in enumerate(counts):
            raw = {
                w: math.log(1 + (whole.items - holders[w] + 0.5) / (holders[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[d] / mean))
                for w, f in c.items()
            }
            total = sum(raw.values())
            for w, x in sorted(raw.items(), key=lambda kv: (kv[1], kv[0])):
                share = x / total
                postings[self.terms[w]].append((d, share))
                if self.aside[d] + share < light * threshold:
                    self.aside[d] += share
                else:
                    essential.append((self.terms[w], d, share))
        self.items = [np.array([d for d, _ in p], np.int64) for p in postings]
        self.shares = [np.array([x for _, x in p]) for p in postings]
        self.tops = [np.maximum.reduceat(x, np.arange(0, len(x), block)).tolist() for x in self.shares]
        self.items, self.shares = [x.tolist() for x in self.items], [x.tolist() for x in self.shares]
        self.top = [max(x) for x in self.shares]
        essential.sort()
        self.e_start = np.searchsorted([e[0] for e in essential], np.arange(len(self.terms) + 1)) if essential else np.zeros(len(self.terms) + 1, np.int64)
        self.e_item = np.array([e[1] for e in essential], np.int64)
        self.e_share = np.array([e[2] for e in essential])

    def admitted(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages with which some item may reach the threshold."""
        lengths = self.e_start[term + 1] - self.e_start[term]
        some = lengths > 0
        keys = np.unique(passage[some] * len(self.terms) + term[some])
        passage, term = keys // len(self.terms), keys % len(self.terms)
        lengths = self.e_start[term + 1] - self.e_start[term]
        at = np.repeat(self.e_start[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        pair, back = np.unique(np.repeat(passage, lengths) * len(self.ids) + self.e_item[at], return_inverse=True)
        reach = np.bincount(back, weights=self.e_share[at], minlength=len(pair)) + self.aside[pair % max(1, len(self.ids))]
        return np.unique(pair[reach >= self.threshold - 1e-9] // max(1, len(self.ids)))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold: a pivot walk over the postings, blocks that cannot reach it skipped."""
        need, block, end = self.threshold - 1e-9, self.block, len(self.ids)
        lists = [(self.items[t], self.shares[t], self.tops[t], self.top[t]) for t in terms]
        at = [0] * len(lists)
        where = [p[0][0] for p in lists]
        out = []
        while True:
            order = sorted(range(len(lists)), key=where.__getitem__)
            total, pivot = 0.0, -1
            for rank, k in enumerate(order):
                if where[k] >= end:
                    break
                total += lists[k][3]
                if total >= need:
                    pivot = rank
                    break
            if pivot < 0:
                return out
            item = where[order[pivot]]
            while pivot + 1 < len(order) and where[order[pivot + 1]] == item:
                pivot += 1
            before = order[:pivot + 1]
            bound, jump = 0.0, end
            for k in before:
                docs, _, tops, _ = lists[k]
                i = at[k] if docs[at[k]] >= item else bisect_left(docs, item, at[k])
                if i < len(docs):
                    bound += tops[i // block]
                    stop = min((i // block + 1) * block, len(docs))
                    jump = min(jump, docs[stop - 1] + 1)
            if bound < need:
                goal = max(item + 1, min([jump, *(where[k] for k in order[pivot + 1:pivot + 2])]))
            else:
                score = 0.0
                for k in before:
                    docs, shares, _, _ = lists[k]
                    i = bisect_left(docs, item, at[k])
                    if i < len(docs) and docs[i] == item:
                        score += shares[i]
                if score >= need:
                    out.append((item, score))
                goal = item + 1
            for k in before:
                docs = lists[k][0]
                at[k] = bisect_left(docs, goal, at[k])
                where[k] = docs[at[k]] if at[k] < len(docs) else end


def matches(texts: pa.Array, index: BlockMaxIndex, n: int, overlap: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(text, item, first word of the passage, score, question's share, answer's share) of every verified hit."""
    stride = index.longest
    words = [words_in(t) for t in texts.to_pylist()]
    get = index.terms.get
    passages, terms, owner, total = [], [], [], 0
    for d, w in enumerate(words):
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        k = at // stride
        earlier = k > 0
        passages += [total + k, total + k[earlier] - 1]
        terms += [ids[at], ids[at][earlier]]
        owner.append(total)
        total += max(1, -(-len(w) // stride))
    for p in index.admitted(np.concatenate(passages), np.concatenate(terms)).tolist() if passages else []:
        d = bisect_left(owner, p + 1) - 1
        first = (p - owner[d]) * stride
        part = words[d][first:first + 2 * stride]
        found = index.search(sorted({index.terms[x] for x in part if x in index.terms}))
        have = grams(part, n) if found else set()
        for item, score in found:
            shares = [sum(_stands(g, have, part, n) for g in s) / len(s) if s else 1.0 for s in index.parts[item]]
            if min(shares) >= overlap:
                yield d, index.ids[item], first, score, *shares


def match_batches(batches: Iterator[pa.RecordBatch], index: BlockMaxIndex, n: int, overlap: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows = list(zip(*matches(batch.column("text"), index, n, overlap), strict=True)) or [()] * 6
        cols = dict(zip([f.name for f in SCHEMA][1:], map(list, rows[1:]), strict=True))
        yield out_batch(SCHEMA, doc_id=batch.column("doc_id").take(pa.array(rows[0], pa.int64())), **cols)


def _stands(gram: tuple[bytes, ...], have: set, part: list[bytes], n: int) -> bool:
    if len(gram) == n:
        return gram in have
    return any(tuple(part[i:i + len(gram)]) == gram for i in range(len(part) - len(gram) + 1))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, by block, and its number of words (without a word)."""
    for batch in batches:
        rows = []
        for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
            question, answer = question_and_answer(text)
            if question:
                rows += [(block, None, len(question + answer)), *((block, w, 0) for w in set(question + answer))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["block", "word", "n"])


def indexes(items: DataFrame, threshold: float, n: int, key: str, text: str) -> Iterator[BlockMaxIndex]:
    """An index for each block of items; blocks have a bounded number of characters on average.

    Weights come from all items: with more than one block their words are counted in Spark first. Items without an id get
    one made of their text, below zero.
    """
    tests = items.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    tests = tests.withColumn("item_id", F.coalesce("item_id", -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))))
    blocks = 1 + (tests.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    if blocks > 1:
        each = stored(tests.select("block", "text").mapInArrow(_item_words, "block long, word binary, n long"), "item-words")
        count, total, longest = each.where("word IS NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
        holders = stored(each.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("items")), "item-holders")
    for k in range(blocks):
        whole = None
        if blocks > 1:  # the words of the block, with their counts over all blocks
            own = holders.join(each.where((F.col("block") == k) & F.col("word").isNotNull()).select("word").distinct(), "word").collect()
            whole = Statistics(count, total, longest, {bytes(r.word): r["items"] for r in own})
        index = BlockMaxIndex([(r.item_id, r.text) for r in tests.where(F.col("block") == k).collect()], threshold, n, whole=whole)
        if index.ids:
            yield index


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, overlap: float = 0.5, n: int = 3,
) -> DataFrame:
    """``doc_id, item_id, first_word, bm25, question, answer``: a row per document and test item found in it (its best passage)."""
    bounded_batches(docs.sparkSession)
    own = keyed(docs, key, text)
    columns = "doc_id long, item_id long, first_word long, bm25 double, question double, answer double"
    found = [
        own.mapInArrow(lambda it, index=index: match_batches(it, index, n, overlap), columns)
        for index in indexes(items, threshold, n, item_key, item_text)
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], columns)
    every = reduce(DataFrame.union, found)
    best = F.max_by(F.struct("first_word", "bm25", "question", "answer"), F.struct("bm25", "question", "answer", -F.col("first_word")))
    return every.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean_only(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, overlap: float = 0.5, n: int = 3,
) -> DataFrame:
    """The rows, with all their columns, in which no test item is found."""

    def free(texts: pa.Array, index: BlockMaxIndex) -> np.ndarray:
        out = np.ones(len(texts), bool)
        out[[m[0] for m in matches(texts, index, n, overlap)]] = False
        return out

    for index in indexes(items, threshold, n, item_key, item_text):
        docs = kept(docs, text, lambda texts, index=index: free(texts, index))
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
