"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). Word capacity flows from a source
of all words through the patterns to the sources' quotas; a pattern's words may be used up to ``repeats`` times, each
further round at a higher cost, so repetition is spread before it is deepened. The network has a node per pattern and per
source, never per document. Each pattern's flow is then taken as whole rounds of all its documents and, for the rest, the
documents that come first in a seeded order.

That order is never sorted as a whole: documents fall into ``CELLS`` ranges of a seeded hash, ranges are summed, and only
the documents of the one range in which a pattern's rest ends are ordered.

Cases: a NULL or empty text has size 0 and takes 0 words; a NULL source is a source of its own, last in order; repeated rows
are documents of their own (equal ones may share a fate); sources of size 0 get target 0; clashing or extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

CELLS = 4096
#: Patterns and sources that the driver plans for at most; more is an error, never a cut.
MOST_PATTERNS = 200_000


def targets_of(sizes: dict[str | None, int], total: int, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Shares of ``total`` by cycling weights; what would exceed ``most`` times a source's size is shared anew by the others."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(total), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in free})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, repeats: int) -> dict[tuple[str, str | None], int]:
    """Cheapest flow (pattern, source) -> words that fills the quotas as far as possible.

    Successive shortest augmenting paths with potentials on the graph start - pattern (one arc per round) - source - end.
    """
    nodes = ["<", ">"] + [("p", p) for p in sorted(capacity)] + [("s", s) for s in quota]
    number = {v: i for i, v in enumerate(nodes)}
    head, room, cost, out = [], [], [], [[] for _ in nodes]

    def arc(a, b, cap, price):
        for u, v, c, w in ((a, b, cap, price), (b, a, 0, -price)):
            out[number[u]].append(len(head))
            head.append(number[v])
            room.append(c)
            cost.append(w)
        return len(head) - 2

    links = {}
    for p in sorted(capacity):
        for k in range(repeats):
            arc("<", ("p", p), capacity[p], k * (k + 1) // 2)
        for s in members[p]:
            links[p, s] = arc(("p", p), ("s", s), repeats * capacity[p], 0)
    for s, q in quota.items():
        arc(("s", s), ">", q, 0)
    potential = [0] * len(nodes)
    while True:
        far = [None] * len(nodes)
        via = [-1] * len(nodes)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                v = head[e]
                if room[e] > 0 and (far[v] is None or d + cost[e] + potential[u] - potential[v] < far[v]):
                    far[v], via[v] = d + cost[e] + potential[u] - potential[v], e
                    heapq.heappush(heap, (far[v], v))
        if far[1] is None:
            break
        potential = [a + (b if b is not None else far[1]) for a, b in zip(potential, far, strict=True)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = head[via[v] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return {k: room[e ^ 1] for k, e in links.items()}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The mix, and its sources.

    ``sources``: array of a document's sources. Returns ``doc_id, pattern, size, taken`` of every row, and
    ``source, source_size, target`` (a row per source; a document in several sources counts in each one's size).
    """
    spark = docs.sparkSession
    pattern = F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), n_words(F.col(f"`{text}`")).alias("size"), pattern.alias("pattern"))
    mark = F.xxhash64(F.lit(seed), "doc_id", "size")
    own = stored(own.select("*", mark.alias("mark"), F.shiftrightunsigned(mark, 52).cast("int").alias("cell")), "mix-sizes")
    found = own.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = {r["pattern"]: r["size"] for r in found}
    members = {p: json.loads(p) for p in capacity}
    sizes: dict[str | None, int] = {}
    for p, some in members.items():
        for s in some:
            sizes[s] = sizes.get(s, 0) + capacity[p]
    target = targets_of(sizes, sum(capacity.values()), weights, most)
    flow = route(capacity, members, {s: int(round(t)) for s, t in target.items()}, most)
    plan = []
    for p, size in capacity.items():
        routed = min(sum(flow[p, s] for s in members[p]), most * size)
        plan.append((p, routed // size if size else 0, routed % size if size else 0))
    plans = spark.createDataFrame(plan, "pattern string, rounds long, rest long")
    shares = spark.createDataFrame([(s, sizes[s], target[s]) for s in sizes], "source string, source_size long, target double")

    cells = own.groupBy("pattern", "cell").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("pattern").orderBy("cell")) - F.col("words")
    cells = cells.select("pattern", "cell", "words", before.alias("before")).join(F.broadcast(plans), "pattern")  # a row per pattern
    last = cells.where("before <= rest AND rest < before + words").select("pattern", F.col("cell").alias("last"), "before")
    known = own.join(F.broadcast(plans), "pattern").join(F.broadcast(last), "pattern", "left")  # both a row per pattern at most
    ordered = W.partitionBy("pattern").orderBy("mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = known.where("cell = last").select(
        "*", ((F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0))) * 2 + F.col("size") <= 2 * F.col("rest")).alias("more"),
    )
    others = known.where("last IS NULL OR cell <> last").select("*", F.coalesce(F.col("cell") < F.col("last"), F.lit(False)).alias("more"))
    taken = F.col("size") * (F.col("rounds") + F.col("more").cast("long"))
    return middle.union(others).select("doc_id", "pattern", "size", taken.alias("taken")), shares


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result: every document has one source."""
    return mixed_documents(table(spark, sf_dir, "documents"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    mix, shares = mix_sources(docs, F.array(F.col("source").cast("string")))
    source = F.get_json_object(F.col("pattern"), "$[0]")
    return (
        mix.withColumn("of", source).join(F.broadcast(shares), F.expr("of <=> source"), "left")  # a row per source
        .select("doc_id", "size", "source_size", "target", "taken")
    )
