"""Pipeline stages over a workspace of tables.

Every stage handles all tickers in one job, writes one table and is skipped
while that table is young and was built from the same settings.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import posixpath
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import detect_language
from ..functions.timing import rolling_retrain_bounds
from ..operators import adaptive as A, direction_model as M, evaluation as E, fusion, normalize as N, predict as P
from ..operators import dedup, price_features as pf, scoring, second_language as second_language_model, sentiment as S, sequences, splits, textgen, training
from ..operators.news import prepare_news, published_column
from ..session import materialize
from ..settings import Settings
from ..sources import readers, writers
from ..sources.manifest import Manifest


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    settings: Settings
    force: bool = False
    rebuilt: set[str] = field(default_factory=set)

    def path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    @property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, self.path("stage"))

    def stage(
        self, name: str, ttl_days: float, sections: Sequence[str], build, upstream: Sequence[str] = (), also: str = "",
        inputs: Callable[[str], list[tuple[str, int, int]]] | None = None,
    ) -> DataFrame:
        """The stage's rows of this workspace's tickers.

        Each ticker has its own entry in the manifest: it is built when it is missing, stale, from other settings
        (``sections``, ``also``), from an ``upstream`` stage's earlier run or from other contents of its ``inputs`` (a ticker's raw
        files).  ``build(path, tickers)`` gets only the tickers that need it and returns their rows, which replace the old
        ones once they are written; all other tickers' rows stay on disk.  A stage may be without rows.
        """
        path, manifest = self.path("stage", name), self.manifest
        sources = [manifest.tickers(u) for u in upstream]
        base = self.settings.signature(*sections) + also
        files = {t: inputs(t) if inputs else [] for t in self.tickers}
        digests = readers.known_digests(self.spark, [f for some in files.values() for f in some], manifest.read(name).get("inputs", {}))
        signatures = {
            t: hashlib.md5("|".join([
                base, *[str(s.get(t, {}).get("completed_at")) for s in sources], *[digests[p][2] for p, _, _ in files[t]],
            ]).encode()).hexdigest()
            for t in self.tickers
        }
        # a forced stage is rebuilt once per workspace, not on every use
        forced = (self.force or self.settings.cache.force_rerun) and name not in self.rebuilt
        stale = [t for t, s in signatures.items() if forced or not manifest.ticker_fresh(name, t, ttl_days, s)]
        if stale:
            manifest.forget(name, stale)
            folder = readers.Folder(self.spark, path)
            before = {t: folder.partition_files("ticker", t) for t in stale}
            rows = build(path, stale)
            if rows is not None:
                writers.write_by_ticker(rows, path)
            for ticker in stale:  # a ticker that ends up without rows must not keep old ones
                if before[ticker] and folder.partition_files("ticker", ticker) == before[ticker]:
                    folder.drop_partition("ticker", ticker)
            manifest.mark_tickers(name, {t: signatures[t] for t in stale}, digests, rows.schema.json() if rows is not None else None)
            self.rebuilt.add(name)
        written = manifest.read(name).get("schema")
        schema = T.StructType.fromJson(json.loads(written)) if written else None
        return readers.read_by_ticker(self.spark, path, schema).filter(F.col("ticker").isin(self.tickers))

    @property
    def tickers(self) -> list[str]:
        if self.settings.tickers is not None:
            return sorted(set(self.settings.tickers))
        return sorted({*readers.price_tickers(self.spark, self.path("raw", "ohlcv")), *readers.table_tickers(self.spark, self.path("raw", "prices"))})


def ingest(ws: Workspace, sources: dict[str, str], multi_line: bool | None = None) -> DataFrame:
    """Tag and merge raw news files (name -> path) into ``raw/merged`` as CSV."""
    tagged = [
        N.tag_and_clean(readers.read_csv(ws.spark, path, multi_line), name, ws.settings.tag_patterns)
        for name, path in sources.items()
    ]
    merged = N.merge_tagged(tagged)
    writers.write_csv(merged, ws.path("raw", "merged"))
    dated = [N.tagged_only(t).select("source", "datetime") for t in tagged if "datetime" in t.columns]
    if dated:  # what merge_tagged had to leave out
        writers.write_json_lines(N.unreadable_dates(N.union_by_name(dated)), ws.path("reports", "unreadable_dates"))
    return merged


def merge_master(ws: Workspace, inputs: Sequence[tuple[str, str]], multi_line: bool | None = None) -> DataFrame:
    """Merge (path, layout) inputs into the master news table, sorted by time, ticker and headline."""
    frames, dated = [], []
    for order, (path, layout) in enumerate(inputs):
        raw = readers.with_row_order(readers.read_csv(ws.spark, path, multi_line, places=True), order)
        dated.append(N.master_dates(raw, posixpath.basename(path), layout))
        frames.append(N.to_master(raw, posixpath.basename(path), layout, carry=[readers.FILE_ORDER, readers.ROW_ORDER]))
    master = dedup.merge_masters(frames).orderBy("datetime", "ticker", "headline", *[readers.FILE_ORDER, readers.ROW_ORDER])
    writers.write_csv(master.select(*N.MASTER_COLUMNS), ws.path("raw", "news", readers.MASTER_NEWS))
    _report_dates(ws, "merge", dated, "source_file")
    return master


def _report_dates(ws: Workspace, step: str, dated: Sequence[DataFrame], by: str) -> None:
    """How many dates of each source no layout reads: those rows are dropped."""
    found = [d for d in dated if d is not None]
    if found:
        counts = N.unreadable_dates(N.union_by_name(found), by=by)
        writers.write_json_lines(counts, ws.path("reports", f"unreadable_dates_{step}"))


def clean(ws: Workspace, path: str, out: str, clean_first: bool = True, limit: int | None = None) -> None:
    """Clean one scraped CSV; rows with a wrong field count are dropped, the input stays, bodies are cut at ``limit``."""
    writers.write_csv(N.clean_scraped(readers.read_csv(ws.spark, path, strict=True), clean_first, limit), out)


def split_prices(ws: Workspace, path: str) -> None:
    """Cut one many-ticker price CSV into the ticker partitions of ``raw/prices``."""
    writers.split_master_prices(readers.read_csv(ws.spark, path), ws.path("raw", "prices"))


TEXT_MODELS, SECOND = "text_models", "second_language"


def second_language(ws: Workspace, per_label: int = 1700) -> str:
    """Fit the second-language scorer on generated texts and save it; the sentiment stage uses it from then on."""
    seeds = ws.spark.range(max(s.mixes for s in textgen.DEFAULT_SETS)).withColumnRenamed("id", "seed")
    other = [s for s in textgen.DEFAULT_SETS if s.lang != "en"]
    texts = materialize(textgen.generate(seeds, "seed", other, target_per_label=per_label), "texts")
    path = ws.path(TEXT_MODELS, SECOND)
    second_language_model.save_scorer(second_language_model.fit_scorer(texts), path)
    return path


def load_second_language(ws: Workspace):
    """The saved scorer, or None."""
    there = readers.Folder(ws.spark, ws.path(TEXT_MODELS)).has(SECOND)
    return second_language_model.load_scorer(ws.path(TEXT_MODELS, SECOND)) if there else None


def sentiment(ws: Workspace, english=None, other=None) -> DataFrame:
    """Rolling daily sentiment of all tickers from the news folder.

    ``english`` and ``other`` are optional model scorers (see ``model_scorer``);
    their scores are stored per article text and never computed twice.
    """
    opts = ws.settings
    version, weights = newest_weights(ws)
    text_models = readers.Folder(ws.spark, ws.path(TEXT_MODELS))
    scorer = f"|{text_models.modified(SECOND)}" if text_models.has(SECOND) else ""

    def build(path: str, tickers: Sequence[str]) -> DataFrame:
        raw = readers.read_news(ws.spark, ws.path("raw", "news"))
        if raw is None:
            raise FileNotFoundError(f"no news files in {ws.path('raw', 'news')}")
        source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in raw.columns else F.lit("unknown")
        _report_dates(ws, "news", [raw.select(published_column(raw.columns).alias("datetime"), source.alias("source"))], "source")
        news = prepare_news(raw, tickers, [readers.FILE_ORDER, readers.ROW_ORDER])
        labelled = detect_language(news, "headline", "detected_lang", opts.nlp.lang_confidence_threshold)
        if english is None:
            scored = scoring.score_by_language(labelled, "headline", "detected_lang", other_model=load_second_language(ws))
        else:
            chosen = F.when(F.col("detected_lang") == "en", english("headline")).when(
                F.col("detected_lang").isin("hi", "hinglish"), (other or english)("headline"))
            scored = scoring.score_with_store(labelled, chosen, ws.path("scores"))
        daily = S.daily_sentiment(
            scored, opts.nlp.hindi_min_articles, lang="detected_lang", weights=weights)
        return S.rolling_sentiment(daily, opts.nlp.sentiment_windows)

    folder = readers.Folder(ws.spark, ws.path("raw"))
    return ws.stage(
        "sentiment", opts.cache.sentiment_ttl_days, ("nlp", "source_weights"), build, also=version + scorer,
        inputs=lambda _: folder.files("news"))


def raw_bars(ws: Workspace, tickers: Sequence[str]) -> DataFrame | None:
    """Bars of the tickers that have any: from ``raw/ohlcv``, one file per ticker, else from the table ``raw/prices``.

    Of the table only the partitions of these tickers are read. Tickers without prices, and those with two bars for a day, are
    left out and listed in ``reports/skipped_prices``. None if no ticker is left.
    """
    have, parts = set(readers.Folder(ws.spark, ws.path("raw", "ohlcv")).names()), set(readers.table_tickers(ws.spark, ws.path("raw", "prices")))
    own = [t for t in tickers if readers.price_file(have, t)]
    split = [t for t in tickers if t not in own and t in parts]
    skipped = [(t, "no prices") for t in tickers if t not in own and t not in split]
    raw = readers.raw_prices(ws.spark, ws.path("raw", "ohlcv"), own)
    if split:
        raw.append(readers.read_by_ticker(ws.spark, ws.path("raw", "prices")).where(F.col("ticker").isin(split)))
    bars = N.union_by_name([N.price_table(r) for r in raw]) if raw else None
    _report_dates(ws, "prices", [N.lower_headers(r).select("ticker", F.col("date").cast("string").alias("datetime")) for r in raw], "ticker")
    if bars is not None:
        twice = bars.groupBy("ticker", "trade_date").count().where("count > 1").select("ticker").distinct().collect()  # of the asked tickers
        skipped += [(r.ticker, "two bars for a day") for r in twice]
        bars = bars.where(~F.col("ticker").isin([r.ticker for r in twice])) if twice else bars
    if skipped:
        writers.write_json_lines(ws.spark.createDataFrame(skipped, "ticker string, reason string"), ws.path("reports", "skipped_prices"))
    return bars


def features(ws: Workspace) -> DataFrame:
    """Warm price-feature rows of all tickers that have prices."""

    def build(path: str, tickers: Sequence[str]) -> DataFrame:
        bars = raw_bars(ws, tickers)
        if bars is None:
            raise FileNotFoundError(f"no prices for {', '.join(tickers)} in {ws.path('raw')}")
        return pf.warm_rows(pf.price_features(bars, ws.settings.features))

    raw = readers.Folder(ws.spark, ws.path("raw"))
    have = readers.Folder(ws.spark, ws.path("raw", "ohlcv")).names()

    def files(ticker: str) -> list[tuple[str, int, int]]:
        name = readers.price_file(have, ticker)
        return raw.files(f"ohlcv/{name}") if name else raw.partition_files("ticker", ticker, "prices")

    return ws.stage("features", ws.settings.cache.features_ttl_days, ("features",), build, inputs=files)


def fuse(ws: Workspace) -> DataFrame:
    """Labelled training sequences of all tickers."""
    opts = ws.settings
    all_prices = features(ws)
    scored = ws.manifest.tickers("sentiment")
    scores = readers.read_sentiment(ws.spark, ws.path("stage", "sentiment")) if scored else None

    def build(path: str, tickers: Sequence[str]) -> DataFrame:
        prices, table = all_prices.filter(F.col("ticker").isin(tickers)), scores
        if table is not None:
            table = table.filter(F.col("ticker").isin(tickers))
        else:  # price-only training: every ticker is uncovered and gets the neutral vector
            empty = prices.select("ticker", "trade_date", *[F.lit(0.0).alias(c) for c in fusion.SENTIMENT])
            table = empty.filter(F.lit(False))
        joined = fusion.attach_sentiment(prices, table)
        labelled = fusion.forward_label(joined, opts.training.label_horizon_days, opts.training.label_threshold)
        ranked = pf.with_window_length(pf.with_atr_percentile(labelled), opts.features)
        return sequences.training_sequences(fusion.with_position(ranked), opts.features)

    sections = ("features", "training")
    return ws.stage("samples", opts.cache.fusion_ttl_days, sections, build, upstream=("features", "sentiment"))


def split_samples(ws: Workspace, bounds=None) -> DataFrame:
    rows = splits.assign_split(fuse(ws), bounds or ws.settings.training.split_bounds)
    return sequences.flat_features(rows).select("ticker", "trade_date", "label", "window", "split", "features")


MODEL = "models"


def _save_model(ws: Workspace, model: M.DirectionModel, fisher: np.ndarray) -> str:
    """A new model version; earlier versions stay as the archive."""
    version = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = ws.path(MODEL, f"version={version}")
    rows = [("fisher", i, float(v)) for i, v in enumerate(fisher)]
    extra = ws.spark.createDataFrame(rows, "name string, idx int, value double")
    model.table(ws.spark).union(extra).write.parquet(path)
    return path


def _load_model(ws: Workspace) -> tuple[M.DirectionModel, np.ndarray]:
    versions = readers.Folder(ws.spark, ws.path(MODEL)).names()
    if not versions:
        raise FileNotFoundError("no model found: run the train stage first")
    table = ws.spark.read.parquet(ws.path(MODEL, versions[-1]))
    fisher = table.filter("name = 'fisher'").orderBy("idx").collect()  # one row per weight
    return M.DirectionModel.from_table(table), np.array([r.value for r in fisher])


def train(ws: Workspace, bounds=None) -> str:
    """Fit on the train split; saves weights with their Fisher terms."""
    rows = materialize(split_samples(ws, bounds), "train-samples")
    model = M.fit(rows, ws.settings.training)
    return _save_model(ws, model, M.fisher(rows.filter("split = 'train'"), model))


def train_epochs(ws: Workspace, epochs: int | None = None, bounds=None) -> str:
    """Epoch-wise training with stored state: continued where an earlier run stopped, the best epoch becomes a new model version."""
    rows = materialize(split_samples(ws, bounds), "train-samples")
    path = ws.path(MODEL + "_epochs")
    training.train_epochs(rows, path, epochs or ws.settings.training.epochs, decay=ws.settings.training.weight_decay)
    training.promote(ws.spark, path)
    model = training.promoted(ws.spark, path).model()
    writers.write_json_lines(training.history(ws.spark, path), ws.path("reports", "epochs"))
    training.prune(ws.spark, path)
    return _save_model(ws, model, M.fisher(rows.filter("split = 'train'"), model))


def scored_split(ws: Workspace, split: str) -> DataFrame:
    """Only the asked split is scored; the result is a table because the report reads it often."""
    model, _ = _load_model(ws)
    rows = split_samples(ws).filter(F.col("split") == split)
    scored = M.mc_scores(rows, model, ws.settings.model, ws.settings.seed).drop("features")
    return materialize(scored.withColumn("row_id", F.xxhash64("ticker", "trade_date")), "scored")


def evaluate(ws: Workspace, split: str = "test") -> dict[str, DataFrame]:
    tables = E.report_tables(scored_split(ws, split), split, ws.settings.evaluation, block_bits=48)
    writers.write_report(tables, ws.path("reports", split))
    return tables


def predict(ws: Workspace, output: str | None = None) -> DataFrame:
    """Newest labelled sample per ticker, judged and written as CSV (to ``predictions`` unless told otherwise)."""
    model, _ = _load_model(ws)
    all_rows = sequences.flat_features(fuse(ws))
    counts = all_rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_samples"))
    newest = sequences.latest_samples(all_rows.select("ticker", "trade_date", "label", "features")).join(counts, "ticker")
    scored = M.mc_scores(newest, model, ws.settings.model, ws.settings.seed, digits=12)  # rounded last
    out = P.judge_latest(scored, ws.settings.model.confidence_threshold).orderBy("date", "ticker")
    writers.write_csv(out, output or ws.path("predictions"))
    return out


def run_cases(ws: Workspace, path: str) -> tuple[DataFrame, DataFrame]:
    """Qualitative cases judged with the current model; also the tickers without prices."""
    model, _ = _load_model(ws)
    cases = readers.read_cases(ws.spark, path)
    prices = features(ws)
    kept = detect_language(P.supported_cases(cases, prices), "news_input", "language")
    kept = kept.withColumn("language", F.when(F.col("language") == "unknown", "en").otherwise(F.col("language")))
    scored = scoring.score_by_language(kept, "news_input", "language", other_model=load_second_language(ws))
    ranked = pf.with_window_length(pf.with_atr_percentile(prices), ws.settings.features)
    latest = sequences.latest_sequence(fusion.with_position(ranked), ws.settings.features)
    joined = scored.join(latest, "ticker").withColumn(
        "sentiment_seq",
        sequences.repeated_sentiment(F.col("pos"), F.col("neg"), F.col("neu"), ws.settings.features.window_max))
    flat = M.mc_scores(sequences.flat_features(joined), model, ws.settings.model, ws.settings.seed, digits=12)
    judged = P.judge_cases(flat).select(
        "ticker", "label", "language", "news_input", "expected_polarity", "sentiment_polarity",
        *[F.round(c, 4).alias(c) for c in ("pos", "neg", "neu")], "net_sentiment", "expected_model_output",
        "actual_model_output", "match_expected", F.col("direction").alias("raw_direction"),
        F.col("prob_up").alias("probability_up"), "variance", "confidence",
        F.date_format("trade_date", "yyyy-MM-dd").alias("latest_price_date_used"),
        F.col("window").alias("effective_window"), "explanation",
    )
    writers.write_csv(judged, ws.path("reports", "cases"))
    return judged, P.dropped_tickers(cases, prices)


def tier1(ws: Workspace, day: str | None = None) -> DataFrame | None:
    """Trust weights updated from one day's prediction log; None without a log or outcomes."""
    day = day or (dt.date.today() - dt.timedelta(days=1)).isoformat()
    folder = readers.Folder(ws.spark, ws.path("logs", "predictions"))
    if not folder.has(f"{day}.json"):
        return None
    log = readers.read_prediction_log(ws.spark, folder.join(f"{day}.json"))
    _, weights = newest_weights(ws, before=day)
    updates = materialize(A.update_weights(A.source_accuracy(log, "row_id"), weights, ws.settings.adaptive.tier1_decay), "tier1")
    if updates.isEmpty():
        return None
    writers.write_weights(A.next_weights(ws.spark, updates, weights), ws.path("weights"), day)
    return updates


def current_weights(ws: Workspace) -> tuple[tuple[str, float], ...]:
    """The trust weights that scoring uses now."""
    return newest_weights(ws)[1]


def newest_weights(ws: Workspace, before: str | None = None) -> tuple[str, tuple[tuple[str, float], ...]]:
    """Version and weights: the newest stored ones (from a day ``before`` the given one), or the configured ones.

    A version's name holds the time of its last rewrite, as a rerun of a day replaces it.
    """
    folder = readers.Folder(ws.spark, ws.path("weights"))
    versions = [v for v in folder.names() if v.startswith("version=") and (before is None or v < f"version={before}")]
    if not versions:
        return "", ws.settings.source_weights
    rows = ws.spark.read.parquet(folder.join(versions[-1])).orderBy("ord").collect()  # one row per key
    return f"{versions[-1]}@{folder.modified(versions[-1])}", tuple((r.key, r.weight) for r in rows)


def tier2(ws: Workspace) -> str:
    """Anchored gradient step on each ticker's most recent samples."""
    model, fisher = _load_model(ws)
    a = ws.settings.adaptive
    recent = sequences.latest_samples(sequences.flat_features(fuse(ws)), a.tier2_nudge_days * 5)
    nudged = M.ewc_nudge(materialize(recent.select("features", "label"), "recent"), model, fisher,
                         a.tier2_ewc_lambda, a.tier2_nudge_lr, a.tier2_nudge_steps)
    return _save_model(ws, nudged, fisher)


def tier3(ws: Workspace, as_of: dt.date | None = None) -> str:
    """Retrain on the rolling window that ends at ``as_of``."""
    moved = rolling_retrain_bounds(as_of or dt.date.today(), ws.settings.adaptive.tier3_window_years)
    training = dataclasses.replace(ws.settings.training, **moved)
    return train(ws, training.split_bounds)


def generate_data(ws: Workspace, per_label: int = 1700) -> DataFrame:
    """Labelled training texts from templates."""
    # keys walk all mixes of templates and slot values in order, so so many seeds hold what there is to pick
    seeds = ws.spark.range(max(per_label * 6, max(s.mixes for s in textgen.DEFAULT_SETS))).withColumnRenamed("id", "seed")
    texts = textgen.generate(seeds, "seed", target_per_label=per_label)
    writers.write_csv(texts, ws.path("datasets", "labelled_texts"))
    return texts


def run_all(ws: Workspace) -> dict[str, DataFrame]:
    """sentiment, features, fuse, train, then the validation report."""
    sentiment(ws)
    features(ws)
    fuse(ws)
    train(ws)
    return evaluate(ws, "val")
