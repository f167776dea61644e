"""Extractive summaries: the sentences that share most with the others.

Sentences are nodes, joined by the words they share; a word weighs the more the fewer sentences hold it. Two rounds pass each
sentence's links on to its neighbours, and the sum is taken per word of the sentence. The graph is never laid out: a round
adds up the ranks of the sentences of each word and takes them back per sentence, which is linear in the number of words.
All sums are whole numbers, so that ranks do not depend on the order of adding.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?]+[.!?]*")
WORD = re.compile("[a-z0-9à-ÿऀ-ॿ]+")
ROUNDS = 2


def sentence_ranks(sentences: list[str]) -> np.ndarray:
    """Rank of each sentence after the fixed rounds; 0 for one without words."""
    sets = [sorted(set(WORD.findall(s.lower()))) for s in sentences]
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(len(sentences))
    _, word = np.unique(np.concatenate([np.array(s, object) for s in sets]).astype(str), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    held = np.bincount(word)
    weight = np.array([(len(sets) // int(n)).bit_length() for n in held], np.int64)
    own = np.zeros(len(sets), np.int64)
    np.add.at(own, owner, weight[word])
    rank = np.ones(len(sets), np.int64)
    for _ in range(ROUNDS):
        shared = np.zeros(len(held), np.int64)
        np.add.at(shared, word, rank[owner])
        passed = np.zeros(len(sets), np.int64)
        np.add.at(passed, owner, (weight * shared)[word])
        rank = passed - own * rank  # a sentence is no neighbour of itself
    return rank / np.maximum(sizes, 1)


def extract(text: str, keep: int) -> str:
    """The ``keep`` best sentences (ties: the earlier) in their order, with one blank between them."""
    sentences = [t for t in (s.strip() for s in SENTENCE.findall(text)) if t]
    if len(sentences) <= keep:
        return " ".join(sentences)
    best = np.argsort(-sentence_ranks(sentences), kind="stable")[:keep]
    return " ".join(sentences[i] for i in sorted(best))


def extractive(keep: int = 3):
    """A summariser for ``scoring.summarise_long``: texts without a sentence give NULL."""

    @F.pandas_udf("string")
    def summarise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else extract(t, keep) or None)

    return summarise
