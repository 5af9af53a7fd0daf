"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, and BENCH_QUERIES (comma-separated; all
queries by the word ``all``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keytally.plans.catalogue import all_queries  # noqa: E402
from keytally.session import local_session  # noqa: E402

HEADLINE = [
    "running_count",
    "running_count_split",
    "word_running_count",
    "emitted_counts",
    "final_count",
    "draw_words",
    "draw_from_vocab",
    "snapshot_at",
    "edit_last_n",
    "snapshot_diff",
    "resume",
    "resume_edited",
    "stream_running_count",
    "stream_resume_edited",
    "stream_word_running_count",
    "largest_file",
    "byte_search",
    "byte_search_encodings",
    "byte_patch",
    "hex_dump",
    "file_range_search",
    "file_range_checksum",
    "checksum_verify",
    "sanitize_hex",
    "parse_offset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        name: round(events / seconds[name])
        for name in ("running_count", "stream_running_count")
        if name in seconds
    }
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
                "records_per_second": rates,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
