"""Operators for training-data pipelines: scoring, search, scans, dedup, mixing, encoding."""
