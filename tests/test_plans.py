"""The physical plans the operators are designed for."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import evaluation as E, price_features as pf
from tickerloom.plans import registry, views as V
from tickerloom.sources import writers

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="test tables missing")

# These run files, streams or model fits while they are being built.
EAGER = {
    "csv_news_roundtrip", "split_by_ticker", "stream_daily_sentiment", "model_fit_score", "score_store", "report_json",
    "csv_master_roundtrip", "stage_partial_rebuild", "tier1_rerun", "sentiment_updated_weights", "stream_backfill", "ewc_nudge_step",
}
# A sequential fold whose every step rounds: a stream over ordered rows.
FOLDS = {"tier1_ema"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    V.bars(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def test_all_features_share_one_exchange_and_one_sort(stored_bars):
    p = plan(pf.warm_rows(pf.price_features(stored_bars)))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and len(re.findall(r"\bSort \[", p)) == 1


def test_ticker_filter_reaches_the_scan(stored_bars):
    p = plan(pf.price_features(stored_bars).filter("ticker = 'F'"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(ticker,F\)", p)


def test_one_feature_reads_only_its_columns(stored_bars):
    p = plan(pf.price_features(stored_bars).select("ticker", "trade_date", "log_ret"))
    assert "ReadSchema: struct<ticker:string,trade_date:date,close:double>" in p


def test_partitioned_table_prunes_by_ticker(spark, stored_bars, tmp_path):
    writers.write_by_ticker(stored_bars, str(tmp_path / "by"))
    p = plan(pf.price_features(spark.read.parquet(str(tmp_path / "by"))).filter("ticker = 'F'"))
    assert re.search(r"PartitionFilters: \[[^\]]*ticker[^\]]*F", p)


def test_texts_are_not_read_for_the_gate(spark):
    assert "text" not in plan(registry.QUERIES["news_gate"](spark, SF_DIR))


def test_tier_thresholds_are_one_subquery(spark):
    df = E.confidence_tiers(E.select_split(V.eval_rows(spark, SF_DIR)))
    assert len(re.findall(r"stddev_samp\(variance", plan(df).split("partial_")[0])) <= 4
    df.collect()
    assert plan(df).count("ReusedSubquery") >= 3


# Matrix products, automata and sentence graphs run in Arrow batches.
MODELS = {"distill_native", "model_predictions", "model_cases", "tag_universe", "summary_extractive", "strict_scan"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER - FOLDS - MODELS))
def test_no_products_and_no_python_in_relational_queries(spark, name):
    p = plan(registry.QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "MapInPandas", "BatchEvalPython"):
        assert bad not in p


def test_monte_carlo_shuffles_nothing(spark):
    assert "Exchange" not in plan(registry.QUERIES["mc_mean_var"](spark, SF_DIR))


def test_the_look_back_bounds_the_scan(spark):
    p = plan(registry.QUERIES["features_since"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", p)


def test_rolling_accuracy_reads_no_events_twice(spark):
    p = plan(registry.QUERIES["eval_rolling30"](spark, SF_DIR))
    assert "events.parquet" not in p and "judged-" in p
