"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from procatlas.plans import rendered, standin  # noqa: E402
from procatlas.plans.catalog import QUERIES  # noqa: E402
from procatlas.session import local_session  # noqa: E402

HEADLINE = [
    "score_owners", "rule_rel_001", "rule_rel_002", "rule_mnt_001", "rule_mnt_002", "rule_mnt_003", "rule_sec_001", "rule_cmp_001",
    "run_rules", "file_totals", "hotspots", "resolve_calls", "summarize_process", "unique_names", "status_transitions",
    "requests_in_trailing_hour", "leaked_values", "content_markers", "redact_literals", "insert_edges_ignore", "tenant_view", "split_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session("bench", cpus)
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    timed("build_estate", lambda: standin.estate(spark, sf_dir))
    for name in wanted:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    megabytes = rendered.order_releases(spark, sf_dir).selectExpr("sum(size_bytes) / 1e6").first()[0]
    lines = standin.table(spark, sf_dir, "lineitem").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "lineitem_rows": lines, "release_megabytes": round(megabytes, 1),
        "parse_mb_per_sec": round(megabytes / times["split_components"], 1) if "split_components" in times else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
