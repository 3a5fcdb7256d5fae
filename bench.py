"""Headline queries, timed: prints one JSON line.

Every query is written to the ``noop`` sink, so all rows and columns are computed and nothing is
collected. One warm-up, then the median of three runs (one run for jobs that write).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from runlens.operators import aggregates as agg  # noqa: E402
from runlens.operators.datagen import generate_words, row_numbers, with_key_value  # noqa: E402
from runlens.plans.catalog import catalog  # noqa: E402
from runlens.session import build_session, work_path  # noqa: E402

HEADLINE = [
    "wordcount", "max_len_per_key", "max_value_per_key", "user_reduce", "runtimes_for_suite", "runtime_summary",
    "median_runtime", "run_details", "extract_flink_v1", "extract_flink_v2", "extract_spark_tasks", "extract_dstat",
    "marker_counts", "delta_lines", "event_sequence", "collapse_consecutive", "insert_missing", "update_by_key",
    "delete_cascade", "pending_runs", "grid_experiments", "scaleout_tiers", "layered_merge", "config_diff",
    "sample_zipf", "gen_words", "gen_key_values", "java_hash", "graph_adjacency", "graph_descendants",
    "tier_members",
]
# Long jobs that write: one warm-up, one run.
WRITING = ["all_events", "suite_refresh", "store_append", "stream_extract", "derived_host_use", "derived_task_durations", "checksum_blocks"]
RUNS = 3
WORDS = 10_000_000
PAIRS = 20_000_000


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_of(build, runs: int = RUNS) -> float:
    drain(build())
    return statistics.median(timed(lambda: drain(build())) for _ in range(runs))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), "16g")
    queries = catalog()
    seconds = {name: median_of(lambda n=name: queries[n](spark, folder)) for name in HEADLINE}
    seconds |= {name: median_of(lambda n=name: queries[n](spark, folder), 1) for name in WRITING}

    # generators at the published setup: 10 000 words, 10 M rows
    generated = {
        f"gen_words_10m_{d}": median_of(lambda d=d, p=p: generate_words(spark, 8, WORDS // 8, 10_000, d, p))
        for d, p in (("uniform", 1.0), ("binomial", 0.5), ("zipf", 1.0))
    }
    # the two aggregation workloads on generated pairs: 1000 rows per key, as in the published data sets
    ratios = {}
    for d, p in (("uniform", 1.0), ("binomial", 0.5), ("zipf", 1.0)):
        path = work_path(spark, f"pairs-{d}")
        with_key_value(row_numbers(spark, 8, PAIRS // 8), "id", PAIRS // 1000, d, p).select("k", "v").write.parquet(path)
        pairs = spark.read.parquet(path)
        x = median_of(lambda pairs=pairs: agg.max_length_per_key(pairs))
        y = median_of(lambda pairs=pairs: agg.max_value_per_key(pairs))
        generated[f"max_len_20m_{d}"], generated[f"max_value_20m_{d}"] = x, y
        ratios[d] = round(y / x, 2)
    seconds.update(generated)
    n_events = spark.read.parquet(f"{folder}/events.parquet").agg(F.count(F.lit(1))).first()[0]
    rates = {
        n: round(n_events / seconds[n]) for n in ("extract_flink_v1", "extract_flink_v2", "extract_spark_tasks", "extract_dstat")
    }
    print(json.dumps({
        "metric": "total seconds of headline queries (median of 3 each)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {n: round(s, 4) for n, s in seconds.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "lines_per_sec": rates,
        "words_per_sec": {n: round(WORDS / s) for n, s in generated.items() if n.startswith("gen_words")},
        "sort_to_hash_ratio": ratios,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
