"""Incremental scans as Structured Streaming jobs."""
