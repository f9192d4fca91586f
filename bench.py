"""Time the headline queries: ``BENCH_SF_DIR``, ``BENCH_CPUS`` -> one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "json_line_items", "answered_json_items", "resolved_videos", "hint_seconds",
    "even_frame_plan", "thinned_frame_plan", "hinted_frame_plan", "rounded_times",
    "readable_prefixes", "plan_keys", "selected_frames", "question_frames", "image_messages",
    "strict_replies", "lenient_replies", "strict_model_answers", "lenient_model_answers",
    "strict_evaluation", "lenient_evaluation",
)


def main() -> None:
    from checks.queries import all_queries
    from clipquest.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Small partitions carry much work here, so let them stay apart.
    spark = local_session(cpus, "bench", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    })
    queries = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds, warm = {}, {}
    for name in HEADLINE:
        seconds[name], warm[name] = timed(name), timed(name)
        print(f"{name} {seconds[name]} {warm[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "warm": warm, "warm_value": round(sum(warm.values()), 3),
        "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
