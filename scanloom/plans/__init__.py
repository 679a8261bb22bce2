"""Named queries over the driver's tables."""

from scanloom.plans import catalog_queries, io_queries, signal_queries, state_queries  # noqa: F401  (registration)
from scanloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
