"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelake.plans.catalogue import QUERIES  # noqa: E402
from pagelake.session import clear_scratch, local_session  # noqa: E402

HEADLINE = (
    "recognition_eval", "overlap_pairs", "detection_eval_per_image", "average_precision", "reading_order", "smooth_metrics",
    "early_stop", "mix_datasets", "sample_store", "build_vocabulary", "bigram_score", "fixed_histogram", "grid_components",
    "hard_negative_mean", "plan_tiles", "keep_owned", "filter_anns", "attach_chars", "ctc_greedy_text", "assign_shard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)), os.environ.get("BENCH_MEMORY", "8g"))
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink computes every row and column without writing them.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    clear_scratch(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
