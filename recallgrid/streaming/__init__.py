"""Structured Streaming variants (additions; the batch operators define the results)."""
