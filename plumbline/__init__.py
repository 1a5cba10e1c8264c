"""Recompute, reconcile and audit reported numbers at scale on Spark."""
