"""Imports every module that registers queries."""

from recallgrid.plans import history, memories, merges, problems, queues, scans, searches, stats, streams, texts, updates  # noqa: F401
from recallgrid.registry import CORE

__all__ = ["CORE"]
