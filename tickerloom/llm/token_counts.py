"""Token counts: how many tokens a tokenizer makes of every whole text, ids thrown away.

Method: texts are cut where the pre-tokenizer cuts them anyway, batches of these pieces are balanced by bytes, encoded by
the library inside Arrow functions, and only lengths leave the function. A piece met again in the same task is not
encoded again.

Cases: a NULL or empty text has 0 bytes and 0 tokens; repeated rows and ids give one row each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import STEP_BYTES, bounded_batches, coded, keyed, out_batch, steps, table

#: Distinct pieces remembered by one task, and bytes of one call of the library.
MEMO, CALL_BYTES = 600_000, 1 << 20
#: One space between two characters that are no white space: the next piece takes the space, whatever stands around.
SAFE = re.compile(r"(?<=\S) (?=\S)")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def lengths_of(tokenizer, pieces: list[str]) -> list[int]:
    """Tokens of each piece; calls balanced by bytes."""
    out: list[int] = []
    call, size = [], 0
    for piece in pieces:
        call.append(piece)
        size += len(piece) + 16
        if size >= CALL_BYTES:
            out += [len(e) for e in tokenizer.encode_batch_fast(call, add_special_tokens=False)]
            call, size = [], 0
    return out + [len(e) for e in tokenizer.encode_batch_fast(call, add_special_tokens=False)]


def safe_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after another, and how many each text has (one at least).

    Where every run of white space in a text is one character long, each space is a safe boundary and a plain split will do.
    """
    words = pc.utf8_split_whitespace(texts)
    at = words.offsets.to_numpy().astype(np.int64)
    filled = np.concatenate(([0], np.cumsum(pc.utf8_length(words.flatten()).to_numpy(zero_copy_only=False), dtype=np.int64)))
    single = filled[at[1:]] - filled[at[:-1]] + np.diff(at) - 1 == pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    del words
    if single.all():
        split = pc.split_pattern(texts, " ")
    else:
        plain = pc.split_pattern(texts.filter(pa.array(single)), " ")
        odd = pa.array([SAFE.split(t) for t in texts.filter(pa.array(~single)).to_pylist()], pa.list_(pa.string()))
        order = np.empty(len(texts), np.int64)
        order[single], order[~single] = np.arange(len(plain)), len(plain) + np.arange(len(odd))
        split = pa.concat_arrays([plain, odd.cast(plain.type)]).take(pa.array(order))
    return split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    first: dict[str, int] = {}  # at the start of a text
    later: dict[str, int] = {}  # after a space
    for batch in steps(batches, limit=4 * STEP_BYTES):
        texts = batch.column("text")
        pieces, counts = safe_pieces(texts)
        ids, distinct = coded(pieces)
        starts = np.cumsum(counts) - counts
        leads = distinct.take(pa.array(np.unique(ids[starts]))).to_pylist()
        known = distinct.to_pylist()
        for memo, new, lead in ((first, leads, ""), (later, known, " ")):
            if len(memo) > MEMO:
                memo.clear()
            fresh = [x for x in new if x not in memo]
            memo.update(zip(fresh, lengths_of(tokenizer, [lead + x for x in fresh]), strict=True))
        size = np.fromiter(map(later.__getitem__, known), np.int64, len(known))
        alone = np.fromiter((first.get(x, 0) for x in known), np.int64, len(known))
        tokens = np.add.reduceat(size[ids], starts) - size[ids[starts]] + alone[ids[starts]]
        yield out_batch(
            SCHEMA, doc_id=batch.column("doc_id"), n_bytes=pc.binary_length(batch.column("text")).cast(pa.int64()),
            n_tokens=tokens, over_limit=tokens > limit,
        )


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row. ``path``: a tokenizer file that every executor has."""
    bounded_batches(docs.sparkSession)
    return keyed(docs, key, text).mapInArrow(
        lambda it: count_batches(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
