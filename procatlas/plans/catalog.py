"""Load every query module, so that the registry is complete."""

from procatlas.plans import aggregates, conversions, exports, expressions, graphs, metadata, privacy, rules, scalars, streams  # noqa: F401
from procatlas.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
