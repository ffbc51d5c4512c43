"""Times the headline queries once each, after one warm-up query, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnwise.plans.catalog import QUERIES  # noqa: E402
from turnwise.session import local_session  # noqa: E402

HEADLINE = (
    "split_stats", "conversation_messages", "chat_render", "prompt_part", "vocabulary_topk", "encode_regex",
    "encode_bytes", "encode_join", "contaminated_documents", "full_labels", "completion_labels", "conversation_labels",
    "padded_batches_right", "exact_split", "prepared_alpaca",
    "primary_metric", "comparison", "accuracy_stderr", "multiple_choice", "exact_match",
    "limit_per_task", "few_shot_context",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["encode_bytes"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
