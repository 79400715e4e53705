"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Every query is run to its last row into the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from newsloom.plans import catalog

HEADLINE = (
    "external_standardized",
    "string_normalize",
    "punct_spacing",
    "boilerplate_filter",
    "wrapper_dedup",
    "text_length_describe",
    "text_length_box",
    "top_terms",
    "collection_stats",
    "stratified_folds",
    "group_folds",
    "confusion_matrix",
    "dedupe_first_seen",
    "url_admission",
    "published_utc",
    "tfidf_vocab",
    "tfidf_weights",
    "pos_ratios",
    "readability",
    "lexicon_sentiment",
    "chunk_embeddings",
    "mean_pool",
    "page_links",
    "pages_parsed",
    "test_results",
    "cv_folds",
    "cv_folds_grouped",
    "experiment_results",
    "nmf_topics",
    "full_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("newsloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("newsloom.input.partitions", cpus)  # the given tables are single files
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
