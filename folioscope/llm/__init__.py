"""Operators for preparing training data: scoring, deduplication, privacy, extraction, counting and packing."""
