"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 3); the median is reported.
The result is consumed in full by a no-op sink, so nothing is skipped by a column-pruned count.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from wayfolio import catalog
from wayfolio.session import local_session

HEADLINE = (
    "a9_audit_report_long", "b1_clean_text", "b5_normalize_category", "b20_quality_score", "b27_html_to_text",
    "c1_search_passages", "c4_text_match", "d1_passages_with_context", "d6_dedupe_three_keys", "d8_merge_fill_missing",
    "d13_places_around_3000", "d14_best_candidate", "d21_load_sections", "e2_top_normalized_labels", "e9_examples_near",
    "e23_corpus_summary", "f1_renumber", "f4_qa_pairs", "f6_assign_sections", "f8_numbering_gaps", "f13_group_units",
    "f17_split_passages", "g2_sort_nearest", "h4_passages_for_terms", "h8_paragraphs_html", "i_validate_lines",
    # the heaviest jobs
    "d6_dedupe_whole_table", "f10_nearest_each", "h4_build_context", "j1_ingest_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores=cores, shuffle=int(cores) if cores.isdigit() else 8)
    every = catalog.queries()
    seconds = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cores": cores, "runs": runs,
    }))


if __name__ == "__main__":
    main()
