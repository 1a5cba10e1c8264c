"""Registered queries; importing this package registers them all."""

from plumbline.plans import links, scoring, statistics, stores, texts  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES, CheckRegistry, query

__all__ = ["ORACLES", "QUERIES", "CheckRegistry", "query"]
