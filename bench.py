"""Times the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job runs once to warm up and once for the clock, from the stored inputs to
a complete result (no sink cost).
"""

from __future__ import annotations

import json
import os
import time

from harness import queries
from harness.compare import local_session
from harness.queries import QUERIES, _results, _site_pages

HEADLINE = {
    "index_lookup": "homepage_lookup",
    "record_decode": "decode_records",
    "contrast_analysis": "page_audit",
    "pairing_list": "page_pairing_list",
    "declaration_rows": "union_declarations",
    "page_summary_rows": "page_contrast_summary",
    "parse_colours_wide": "parse_colour",
    "parse_colours_repeated": "parse_colour_once",
    "classify_pairs_wide": "classify_pairs",
    "dedup_pairs_wide": "dedup_pairings_wide",
    "category_rollup": "category_rollup",
    "audit_summary": "audit_summary",
    "audit_report": "audit_report",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark, queries.PARTITIONS = local_session(cores), int(cores)
    pages = _site_pages(spark, folder).count()
    _results(spark, folder).count()
    seconds = {}
    for label, name in HEADLINE.items():
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[label] = round(time.time() - start, 3)
    result = {
        "metric": "headline jobs, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "pages": pages,
        "analysis_pages_per_sec": round(pages / seconds["contrast_analysis"], 1),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
