"""Tags for texts from thousands of names: one automaton in place of a chain of conditions.

The automaton (a trie with failure links) reads a text once, whatever the number of names. Names go to every task only within
``limit`` bytes; a larger list is cut into blocks of that size, each block is a pass of its own over the texts, and the passes
are folded in the row, so that neither memory nor the result depends on the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of names in one automaton.
LIMIT = 8 << 20


def _automaton(names: list[tuple[str, int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name, ord_ in names:
        found.add_word(name, ord_)
    found.make_automaton()
    return found


def _finder(names: list[tuple[str, int]]):
    """struct<best, n>: the last place in the list among the names in a text, and how many names are in it."""
    @F.pandas_udf("best long, n long")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(names)
        for batch in texts:
            hits = [{o for _, o in automaton.iter(t)} for t in batch.fillna("")]
            yield pd.DataFrame({"best": pd.array([max(h, default=None) for h in hits], "Int64"), "n": [len(h) for h in hits]})

    return find


def listed_names(names: DataFrame) -> DataFrame:
    """``name, ord, tag``: names lower-cased, each once with its last place in the list; empty ones name nothing."""
    low = names.select(F.lower("name").alias("name"), F.col("ord").cast("long").alias("ord"), "tag").where(F.length("name") > 0)
    return low.groupBy("name").agg(F.max("ord").alias("ord"), F.max_by("tag", "ord").alias("tag"))


def tag_names(df: DataFrame, text: str, names: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``tag`` (of the last listed name in the text, case-insensitive; empty if none) and ``n_names`` (names in the text).

    ``names`` has ``name, ord, tag``, ``ord`` being its unique place in the list. NULL texts have no names.
    """
    listed = materialize(listed_names(names), "names")
    size = listed.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0))).first()[0]
    count = -(-size // limit)
    out_of = F.pmod(F.xxhash64("name"), F.lit(max(1, count)))
    out = df.withColumns({"_low": F.lower(text), "_best": F.lit(None).cast("long"), "n_names": F.lit(0).cast("long")})
    for block in range(count):
        held = [(r.name, r.ord) for r in listed.where(out_of == block).select("name", "ord").collect()]  # about ``limit`` bytes
        if not held:
            continue
        found = out.withColumn("_f", _finder(held)("_low"))
        out = found.withColumns({"_best": F.greatest("_best", "_f.best"), "n_names": F.col("n_names") + F.col("_f.n")}).drop("_f")
        if block + 1 < count:
            out = materialize(out, "tagged")
    tags = listed.select(F.col("ord").alias("_best"), "tag")
    return out.drop("_low").join(tags, "_best", "left").drop("_best").withColumn("tag", F.coalesce("tag", F.lit("")))

