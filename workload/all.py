"""Import every query module once."""

import importlib

MODULES = (
    "q_paths", "q_records", "q_policy", "q_sync", "q_groups", "q_report", "q_manifest", "q_raster",
    "q_audit", "q_plans", "q_evidence", "q_sources", "q_streaming",
)
for _name in MODULES:
    try:
        importlib.import_module(f"workload.{_name}")
    except ModuleNotFoundError as error:
        if not str(error.name).startswith("workload."):
            raise
