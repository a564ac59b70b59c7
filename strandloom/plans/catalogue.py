"""All registered queries."""

from strandloom.plans import queries_iterative, queries_relational, queries_scalar  # noqa: F401
from strandloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
