"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the number of
local cores (default 8), BENCH_RUNS the number of timed runs (default 2). Every query runs once
untimed at the same scale first; the median of the timed runs is reported. Results are consumed
in full by a no-op write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalink.plans.catalogue import all_queries  # noqa: E402
from catalink.session import build_session  # noqa: E402

HEADLINE = (
    "clean_tokens", "trigrams", "tfidf_weights", "trigram_count_weights", "link_by_text",
    "link_by_trigram", "all_similarities", "posts_per_item", "true_item_ranks", "link_quality",
    "keyword_membership", "phrase_matches", "post_keywords", "post_sentiment",
    "labelled_vectors_join", "reduced_average", "reduced_median", "linked_features",
    "topic_sentiment_windows", "undersampled",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.ui.showConsoleProgress": "false"})
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, median of warm runs", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
