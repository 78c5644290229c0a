"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from folioscript.plans.registry import all_queries  # noqa: E402

HEADLINE = [
    "book_chunk_summary", "small_chunks_with_hard_split", "model_pieces", "normalize_text", "chapter_detection", "title_announcements",
    "quote_spans", "assembled_script", "final_script", "reader_blocks", "phrase_timing",
    "pause_policy", "segment_start_times", "playhead_lookup", "running_progress", "script_stats",
    "speaker_resolution", "segment_voices", "best_voice", "distinct_voices", "mention_merge", "alias_components",
    "stale_chapters", "segment_edits", "book_status_rollup", "nested_book_pages", "status_changes", "job_outcome",
    "render_plan", "cache_probe", "stitch_chains",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    queries, times = all_queries(), {}
    for name in HEADLINE:
        started = time.time()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
