"""Headline queries at $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import time

from factloom.plans import registry
from factloom.session import get_spark

HEADLINE = ["ground_quotes", "doc_chunks", "section_chunks", "triple_ids", "edge_merge", "nodes_first_write", "edges_last_write", "materialize", "verdict_merge", "two_hop", "harvest_store", "run_stats", "metrics_by_group", "resolve_prefilter"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    found = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
