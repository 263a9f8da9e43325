"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the number of local cores.
Every query is run to the end (all rows and columns are computed) twice: the first run warms
the JVM up, the second counts.
"""

from __future__ import annotations

import json
import os
import time

from newsloom.catalog import QUERIES
from newsloom.session import local_session

HEADLINE = [
    "domain_policy_join",
    "host_split",
    "fetch_plan",
    "retrieval_outcome",
    "page_quality",
    "view_blanking",
    "reader_quality",
    "html_text",
    "tidy_body",
    "language_guess",
    "author_rule",
    "raw_articles",
    "reader_articles",
    "merge_fields",
    "parse_job",
    "pdf_articles_of",
    "capture_parse",
    "capture_order",
    "captures_collect",
    "first_usable",
    "latest_state",
    "state_funnel",
    "worklist_top500",
    "chunk_assign",
    "parsed_running_total",
    "import_antijoin",
    "redirect_resolve",
    "payload_lookup",
    "parse_log",
    "capture_parse_lateral",
    "drain_articles",
    "stream_flags",
    "stream_import",
]


def seconds(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "newsloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, folder, name)
        times[name] = round(seconds(spark, folder, name), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
