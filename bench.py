"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from driftspark.plans.queries import QUERIES
from driftspark.session import build_session

HEADLINE = [
    "payload_field_types", "payload_nested_types", "payload_array_items", "payload_latest_schema", "payload_eligibility",
    "merge_provenance", "merge_twice", "sample_applied", "carry_forward_accept",
    "contract_diff_endpoints", "contract_diff_fields", "contract_diff_status_desc", "drift_report_gate",
    "route_methods", "source_signals", "consumer_refs", "impact_table",
    "contract_as_of", "registry_search", "tool_catalog", "tool_inputs",
    "debounced_checks", "debounced_stream", "continuous_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    cores = int(cpus) if cpus.isdigit() else 8
    # The bench tables have one row group each: they are dealt out over the cores.
    spark = build_session(f"local[{cpus}]", cores, deal=cores, warehouse=tempfile.mkdtemp(prefix="driftspark-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("sum(o_totalprice)").collect()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
