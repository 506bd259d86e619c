"""Import every query module so that the registry is complete."""

from __future__ import annotations

from herbaria.plans import (q_aggs, q_exports, q_filters, q_joins, q_matching, q_more, q_mutate, q_sets,  # noqa: F401
                            q_features, q_sources)
from herbaria.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
