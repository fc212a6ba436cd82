"""Asset-catalogue analytics as composable Spark DataFrame operators.

Tables (or streams) of assets, pages, metadata records, run results and
manifests go in; plans, verdicts, proofs and reports come out.  Nothing here
opens, rewrites or removes a user's file.
"""

from shelfmark.config import DeriveConfig, GateConfig, LayoutConfig, PolicyConfig, layout_for

__all__ = ["DeriveConfig", "GateConfig", "LayoutConfig", "PolicyConfig", "layout_for"]
