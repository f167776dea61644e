"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tickerloom.plans.registry import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "bars_daily", "volume_bars", "price_features", "features_since", "dynamic_window",
    "article_scores", "clean_text_slice", "lang_ratio", "headline_tagging", "ingest_tagged", "news_dedup_hash",
    "news_merge_dedup", "daily_sentiment", "sentiment_rolling", "fuse_ffill", "fused_samples", "sequences_train",
    "eval_overall", "eval_tiers", "eval_per_ticker", "eval_rolling30", "ece", "tier1_ema", "mc_mean_var",
    "predict_latest", "qualitative_cases", "stream_daily_sentiment", "model_fit_score",
)


def run(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    )
    for name in ("bars_daily", "article_scores"):  # JIT and file-system warm-up
        run(spark, name)
    seconds = {name: round(run(spark, name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
