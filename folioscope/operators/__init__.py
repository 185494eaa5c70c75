"""Catalog queries, keyed writes, statistics and evaluation."""
