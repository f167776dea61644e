"""Incremental daily sentiment and bars.

Only day-level aggregates stream natively: on a clock moved by the time after
the close, a trading date is a calendar day and thus an aggregation window.  Row-count windows over
days are recomputed from the day-level tables, which are small.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sentiment import class_means
from ..settings import MARKET_CLOSE_SECONDS
from ..sources.readers import Folder


GATE_TIME = "_gate_time"


def with_gate_time(articles: DataFrame, published: str = "pub_dt", zone: str = "UTC") -> DataFrame:
    """Adds the market clock moved so that midnight falls on the close.

    ``published`` is a TIMESTAMP (watermarks reject zone-less ones); ``zone`` is
    the market's zone.  A calendar day of the moved clock is one trading date.
    """
    local = F.from_utc_timestamp(F.col(published), zone)
    return articles.withColumn(GATE_TIME, F.timestamp_add("SECOND", F.lit(86_400 - MARKET_CLOSE_SECONDS), local))


def gate_day(time: str | Column) -> Column:
    """Day of a gate time, counted from the epoch so that the session's zone plays no part."""
    days = F.floor(F.unix_seconds(F.col(time) if isinstance(time, str) else time) / 86_400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def daily_class_sums(articles: DataFrame, published: str = "pub_dt", zone: str = "UTC", lateness: str = "2 days",
                     **options) -> DataFrame:
    """Streaming per (ticker, trading date) sums; feed them to ``blend_classes``.

    The watermark is set on the very column the one-day window groups by, so
    finished days leave the state.
    """
    timed = with_gate_time(articles, published, zone).withWatermark(GATE_TIME, lateness)
    sums = class_means(timed, day=F.window(GATE_TIME, "1 day").alias("day"), **options)
    return sums.withColumn("trade_date", gate_day(F.col("day.start"))).drop("day")


def upsert_by_batch(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run an updating aggregate over the available data; each batch appends its changed rows.

    Operators with own state that emit changed rows themselves run in ``append`` mode.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        # overwriting the batch's own folder makes a replayed batch idempotent
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_state(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key among the rows appended by :func:`upsert_by_batch`."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def add_by_batch(articles: DataFrame, path: str, checkpoint: str, published: str = "pub_dt", zone: str = "UTC", **options) -> StreamingQuery:
    """Class sums of each micro-batch of articles, appended; :func:`summed` adds them up.

    The sums of a trading date are additive, so an article counts whenever it comes: there is no watermark, no state and
    nothing is too late.  A replayed batch overwrites its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        timed = with_gate_time(batch, published, zone).withColumn("trade_date", gate_day(GATE_TIME))
        class_means(timed, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        articles.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _newest(folder: Folder, kind: str) -> int:
    found = [int(n.split("=")[1]) for n in folder.names() if n.startswith(f"{kind}=")]
    return max((i for i in found if folder.has(f"{kind}={i}/_SUCCESS")), default=-1)


def summed(spark: SparkSession, path: str) -> DataFrame:
    """The sums per (ticker, trade_date) of all batches at ``path``."""
    folder = Folder(spark, path)
    base, last = _newest(folder, "base"), _newest(folder, "batch")
    parts = [f"base={base}"] if base >= 0 else []
    parts += [f"batch={i}" for i in range(base + 1, last + 1) if folder.has(f"batch={i}/_SUCCESS")]
    rows = spark.read.parquet(*[folder.join(p) for p in parts])
    keys = ("ticker", "trade_date")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def compact(spark: SparkSession, path: str) -> None:
    """Fold all batches so far into one table keyed by day; later reads start from it."""
    last = _newest(Folder(spark, path), "batch")
    if last > _newest(Folder(spark, path), "base"):
        summed(spark, path).write.mode("overwrite").parquet(f"{path}/base={last}")


SUMS = ("en_count", "en_w", "en_pos", "en_neg", "en_neu", "hi_count", "hi_w", "hi_pos", "hi_neg", "hi_neu")
ROLLED = "ticker string, trade_date date, " + ", ".join(f"{p}_{n}d double" for n in (1, 3, 7) for p in ("pos", "neg", "neu"))


def _roll(held: dict[int, list[float]], changed: set[int], min_articles: int, windows: Sequence[int], fill_limit: int) -> list[tuple]:
    """Rolling rows of the changed days and of the later news days whose windows reach back to one."""
    days = sorted(held)
    daily = []
    for day in days:
        v = dict(zip(SUMS, held[day], strict=True))
        n = v["hi_count"]
        w = 0.0 if n < min_articles else min(1.0, n / (2.0 * min_articles))
        mean = {}
        for tag in ("en", "hi"):
            for part, neutral in (("pos", 0.0), ("neg", 0.0), ("neu", 1.0)):
                total = v[f"{tag}_w"]
                mean[tag, part] = neutral if v[f"{tag}_count"] == 0 else v[f"{tag}_{part}"] / total if total else None
        blended = []
        for part in ("pos", "neg", "neu"):
            a, b = mean["en", part], mean["hi", part]
            blended.append(None if a is None or b is None else (1.0 - w) * a + w * b)
        daily.append(blended)
    filled, last = [], [(-1, None)] * 3
    for at, row in enumerate(daily):
        last = [(at, x) if x is not None else old for x, old in zip(row, last, strict=True)]
        filled.append([x if at - k <= fill_limit else None for k, x in last])
    out, reach = [], max(windows) + fill_limit
    for at, day in enumerate(days):
        if not any(d in changed for d in days[max(0, at - reach):at + 1]):
            continue
        row: list = []
        for n in windows:
            for part in range(3):
                some = [f[part] for f in filled[max(0, at - n + 1):at + 1] if f[part] is not None]
                row.append(sum(some) / len(some) if some else None)
        out.append((day, *row))
    return out


def rolling_by_ticker(sums: DataFrame, min_articles: int = 3, windows: Sequence[int] = (1, 3, 7), fill_limit: int = 5) -> DataFrame:
    """Rolling means of a stream of partial day sums (``class_means`` of each piece), kept up to date.

    State per ticker: the sums of its news days (one small row a day). A piece adds to its days, however late it comes, and the
    rows of these days and of the following ones within a window's reach are emitted again; the newest row of a
    (ticker, day) holds.
    """

    def update(key, pieces, state):
        held = {int(d): v for d, v in json.loads(state.get[0]).items()} if state.exists else {}
        changed: set[int] = set()
        for pdf in pieces:
            for row in pdf[["trade_date", *SUMS]].fillna(dict.fromkeys(SUMS, 0.0)).itertuples(index=False):
                day = row[0].toordinal()
                held[day] = [a + float(b) for a, b in zip(held.get(day, [0.0] * len(SUMS)), row[1:], strict=True)]
                changed.add(day)
        state.update((json.dumps(held),))
        rows = _roll(held, changed, min_articles, windows, fill_limit)
        names = [c.split()[0] for c in ROLLED.split(", ")]
        yield pd.DataFrame([(key[0], dt.date.fromordinal(d), *x) for d, *x in rows], columns=names)

    return sums.select("ticker", "trade_date", *SUMS).groupBy("ticker").applyInPandasWithState(update, ROLLED, "held string", "append", "NoTimeout")
