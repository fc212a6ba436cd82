"""Headline queries at one scale factor, one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.session import local_session  # noqa: E402

HEADLINE = (
    "destination_by_mode", "duplicate_destinations", "sync_plan", "same_bytes", "overwrite_guard",
    "source_kind", "plan_pages_split", "demote_duplicates", "assemble_groups", "group_status",
    "split_by_content", "merge_lineage", "chain_generations", "chain_steps", "classify_reencode",
    "resolve_action", "size_stats_lines", "expand_manifest", "source_overlaps", "compare_rasters",
    "audit_containers", "plan_archive", "plan_restore", "plan_derive_actions", "plan_transcode",
    "archive_gate", "derive_gate", "check_manifest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    import workload.all  # noqa: F401
    from workload.registry import REGISTRY

    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's machinery
    timings = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink runs the whole plan without gathering anything.
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
