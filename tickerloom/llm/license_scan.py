"""License scans by a positional rare-token index.

The licence templates below are indexed once: a word's postings name the templates that hold it and its positions there. How
rare a licence word is comes from the scanned corpus itself (documents that hold it, over all of them). Of each file the licence
words are looked up from the rarest to the most common one; the first of them that a template's mandatory phrase needs proposes
starts (its positions in the file less those in the template), the next ones are intersected with these by relative
position, and a start on which ``rare`` of them agree is verified: the mandatory phrase must stand there, word by word.

The score tells a whole notice from a mention: the share of the template's words found in place, each counted by its
rarity. A phrase alone has a small score, the whole notice has 1; it decides nothing else.

The four base phrases are the mandatory phrases of notices of their own, so that every place is found.

Cases: NULL and empty texts have 0 words, empty labels, NULL positions and score 0; equal rows give equal results, one each;
ties in rarity are broken by the word; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, out_batch, steps, table

#: The phrases every scan must find, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The notice around each base phrase, for the score; other notices of the licence are templates below.
NOTICES = {
    "gnu general public license": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "apache license": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc by": "this work is licensed under a creative commons attribution license cc by",
    "mit license": "this software is released under the terms of the mit license",
}
#: Own list of short public notices: text, mandatory phrase, label.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc by nd", "cc-by-nd"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("this work is released under cc0 1 0 universal", "cc0 1 0", "cc0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("released under the bsd 3 clause license", "bsd 3 clause license", "bsd"),
    ("subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("made available under the eclipse public license", "eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "released into the public domain", "public-domain"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software", "isc"),
    ("all rights reserved no part may be reproduced without written permission", "all rights reserved", "proprietary"),
)
#: A-Z to a-z; bytes that belong to no word to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COLUMNS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_matches long"
)
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_matches", pa.int64()),
])


def words_in(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    label: str
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.key)


def templates() -> tuple[Template, ...]:
    own = [(text, key, label, False) for text, key, label in TEMPLATES]
    return tuple(
        Template(tuple(words_in(text)), tuple(words_in(key)), label, base)
        for text, key, label, base in [(NOTICES[p], p, label, True) for p, label in BASE] + own
    )


class RareIndex:
    """Postings (template, position) of the words of the mandatory phrases, and how rare every licence word is."""

    def __init__(self, found: tuple[Template, ...], holders: dict[bytes, int], n_docs: int, rare: int):
        self.templates, self.rare = found, rare
        self.idf = {w: math.log(1 + (n_docs + 1) / (holders.get(w, 0) + 1)) for t in found for w in t.words}
        order = sorted(self.idf, key=lambda w: (-self.idf[w], w))
        self.rank = {w: r for r, w in enumerate(order)}
        self.weight = [sum(self.idf[w] for w in t.words) for t in found]
        self.distinct = [min(rare, len(set(t.key))) for t in found]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(found):
            for i, w in enumerate(t.key, t.key_at):  # where one of these lacks, nothing is verified
                self.postings.setdefault(w, []).append((k, i))

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words in place, by rarity) of every verified place."""
        places: dict[bytes, list[int]] = {}
        for at, word in enumerate(words):
            if word in self.postings:
                places.setdefault(word, []).append(at)
        starts: dict[int, set[int]] = {}  # of a template: the starts on which all looked up words agree
        looked: Counter = Counter()
        for word in sorted(places, key=self.rank.__getitem__):
            of: dict[int, list[int]] = {}
            for k, i in self.postings[word]:
                of.setdefault(k, []).append(i)
            for k, inside in of.items():
                if looked[k] < self.rare:
                    looked[k] += 1
                    for i in inside:
                        if k not in starts:
                            starts[k] = {at - i for at in places[word]}
                        elif starts[k]:
                            starts[k] = starts[k].intersection([at - i for at in places[word]])
        out, n = [], len(words)
        for k, agreed in starts.items():
            t = self.templates[k]
            if looked[k] < self.distinct[k]:
                continue
            for start in sorted(agreed):
                at = start + t.key_at
                if tuple(words[at:at + len(t.key)]) == t.key:
                    stand = sum(self.idf[w] for i, w in enumerate(t.words, start) if 0 <= i < n and words[i] == w)
                    out.append((k, start, min(1.0, stand / self.weight[k])))
        return out


def scan_batches(batches: Iterator[pa.RecordBatch], index: RareIndex) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        cols: dict[str, list] = {f.name: [] for f in SCHEMA if f.name != "doc_id"}
        for text in batch.column("text").to_pylist():
            words = words_in(text)
            found = index.matches(words)
            base = [(index.templates[k].label, start + index.templates[k].key_at) for k, start, _ in found if index.templates[k].base]
            starts = [start for _, start in base]
            row = (
                len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})),
                ",".join(sorted({index.templates[k].label for k, _, _ in found})), max((s for _, _, s in found), default=0.0), len(found),
            )
            for name, value in zip(cols, row, strict=True):
                cols[name].append(value)
        yield out_batch(SCHEMA, doc_id=batch.column("doc_id"), **cols)


def holder_batches(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in steps(batches):
        for text in batch.column("text").to_pylist():
            seen.update(vocabulary.intersection(words_in(text)))
            seen[b""] += 1
    yield pa.RecordBatch.from_pydict(
        {"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]),
    )


def license_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 3,
) -> DataFrame:
    """One row per document: words, base places, labels of all verified templates, best score, number of verified places.

    ``rare``: a file's words looked up per template.
    """
    bounded_batches(docs.sparkSession)
    found = templates()
    vocabulary = frozenset(w for t in found for w in t.words)
    own = keyed(docs, key, text)
    counts = own.select("text").mapInArrow(lambda it: holder_batches(it, vocabulary), "word binary, n long")
    holders = {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per licence word
    index = RareIndex(found, holders, holders.pop(b"", 0), rare)
    return own.mapInArrow(lambda it: scan_batches(it, index), COLUMNS)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
