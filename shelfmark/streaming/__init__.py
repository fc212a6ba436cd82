"""Incremental forms of the batch operators on Structured Streaming."""

from shelfmark.streaming.streams import (
    run_to_table, stream_assets, stream_groups, stream_sessions, stream_status, sync_batches)

__all__ = [
    "run_to_table", "stream_assets", "stream_groups", "stream_sessions", "stream_status",
    "sync_batches"]
