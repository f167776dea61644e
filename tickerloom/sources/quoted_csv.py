"""CSV files with quoted line breaks, read in splits.

Whether a line break ends a record depends on all quotes before it. Reading a file by byte ranges therefore takes two passes:
the first works out, for each range, in which state it ends if it starts outside and if it starts inside a quoted field, and
these small maps are chained over the ranges of a file; the second cuts each range into records from its now known state.
A record that runs over range ends comes in fragments, at most two a range, which are put together by the range it starts in.

Only ``\\n`` ends a line (a ``\\r`` before it goes with it); a quote opens a field only at its start, is doubled inside, and
closes it otherwise. A field open at the end of a file ends with the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

RANGES = "file string, start long, from_outside boolean, from_inside boolean, closed boolean, broken boolean"
RECORDS = "file string, start long, n long, home long, whole boolean, record string"
#: Ranges whose states may be sent to every task; beyond, the caller reads whole files.
BROADCAST_RANGES = 1_000_000
#: Lines of one Python step.
LINES = 8192


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind the line."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, paths) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray]]:
    """Slices of lines of one range, in order, with the places of the lines that hold a quote."""
    for whole in batches:
        for begin in range(0, whole.num_rows, LINES):
            batch = whole.slice(begin, LINES)
            starts = batch.column("start").to_numpy()
            files = batch.column("file").dictionary_encode().indices.to_numpy()
            ends = [*(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip([0, *ends], ends):
                part = batch.slice(a, b - a)
                quoted = np.flatnonzero(pc.match_substring(part.column("value"), '"').to_numpy(zero_copy_only=False))
                yield (part.column("file")[0].as_py(), int(starts[a])), part, quoted


def _range_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range: the state at its end from both starts, whether a range that starts inside closes, whether a line ends inside."""
    now, out, inside, closed, broken = None, [], [False, True], False, False

    def row():
        return {"file": now[0], "start": now[1], "from_outside": inside[0], "from_inside": inside[1], "closed": closed, "broken": broken}

    for key, part, quoted in _runs(batches):
        if key != now:
            if now:
                out.append(row())
            now, inside, closed, broken = key, [False, True], False, False
        for line in part.column("value").take(pa.array(quoted)).to_pylist():
            inside = [inside_after(line, s) for s in inside]
            closed |= not inside[1]
            broken |= inside[0]
    if now:
        out.append(row())
    names = [c.split()[0] for c in RANGES.split(", ")]
    if out:
        yield pa.RecordBatch.from_pydict({c: [r[c] for r in out] for c in names})


def ranges(spark: SparkSession, paths) -> DataFrame:
    """``file, start, inside, home, broken`` of every range: its starting state, and where a record open at its start began."""
    maps = materialize(_lines(spark, paths).mapInArrow(_range_states, RANGES), "csv-ranges")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    # A map either forgets the state or keeps or swaps it: the state is that of the last range that forgets, with the swaps since.
    swaps = F.coalesce(F.sum(F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)).over(before), F.lit(0))
    counted = maps.withColumn("swaps", swaps)
    forgot = F.when(F.col("from_outside") == F.col("from_inside"), (F.col("swaps") % 2 == 1) != F.col("from_outside"))
    known = counted.withColumn("inside", (F.coalesce(F.last(forgot, ignorenulls=True).over(before), F.lit(False))) != (F.col("swaps") % 2 == 1))
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    opens = F.when(ends & (~F.col("inside") | F.col("closed")), F.col("start"))
    return known.select("file", "start", "inside", ends.alias("ends"), F.last(opens, ignorenulls=True).over(before).alias("home"), "broken")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of records; ``n`` counts them within their range."""
    now, inside, held, n, head, home = None, False, [], 0, False, None
    out: list[tuple] = []

    def put(whole: bool, owner: int | None):
        nonlocal n
        text = "\n".join(held)
        out.append((*now, n, owner, whole, text.removesuffix("\r") if whole else text))
        n += 1
        held.clear()

    def flush():
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RECORDS.split(", ")])

    for key, part, quoted in _runs(batches):
        if key != now:
            if now and held:
                put(False, home if head else now[1])
            state = part.column("inside")[0].as_py()
            if state is None:
                raise RuntimeError("file ranges have changed between two passes; set spark.sql.files.minPartitionNum")
            now, inside, n, head, home = key, state, 0, state, part.column("home")[0].as_py()
        with_quote = set(quoted.tolist())
        for at, line in enumerate(part.column("value").to_pylist()):
            if not inside and at not in with_quote:
                held.append(line)
                put(True, now[1])
                continue
            held.append(line)
            if at in with_quote:
                inside = inside_after(line, inside)
            if not inside:
                put(not head, home if head else now[1])
                head = False
        if out:
            yield flush()
    if now and held:
        put(False, home if head else now[1])
    if out:
        yield flush()


def records(spark: SparkSession, paths, known: DataFrame) -> DataFrame:
    """``file, start, n, record``: every record once, with its place."""
    state = F.broadcast(known.select("file", "start", "inside", "ends", "home"))
    lines = _lines(spark, paths).join(state, ["file", "start"], "left")

    def cut(some: DataFrame) -> DataFrame:
        return some.select("file", "start", "value", "inside", "home").mapInArrow(_cut, RECORDS)

    whole = cut(lines).where("whole").select("file", "start", "n", "record")
    # Only ranges with an open end are cut again for their fragments.
    parts = cut(lines.where("inside OR ends")).where("NOT whole")
    joined = parts.groupBy("file", "home").agg(F.sort_array(F.collect_list(F.struct("start", "n", "record"))).alias("parts"))
    joined = joined.select("file", F.col("home").alias("start"), F.col("parts")[0]["n"].alias("n"), F.regexp_replace(F.array_join(F.col("parts.record"), "\n"), "\r\\z", "").alias("record"))
    return whole.unionByName(joined)
