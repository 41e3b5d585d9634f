"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder and BENCH_CPUS the number of local cores. Every query is run to
completion without keeping its rows; the reported time is the better of two runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from spanferry.queries import QUERIES
from spanferry.session import build_session

HEADLINE = [
    "copy_events",
    "copy_counters",
    "dedup_first",
    "anti_seen",
    "keyset_page",
    "match_name_last",
    "remap_fk_null",
    "remap_polymorphic",
    "remap_array",
    "remap_refs_keep",
    "classify_acl",
    "equivalent_after_remap",
    "status_rollup",
    "top_n_per_reason",
    "batch_by_count",
    "batch_bytes",
    "page_cursors",
    "spill_rows",
    "rewrite_attachments",
    "dependency_levels",
    "schema_diff",
    "write_routed",
    "copy_objects",
    "replicate_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["status_counts"](spark, sf_dir).collect()
    times = {}
    for name in chosen:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
