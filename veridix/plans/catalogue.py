"""Queries by name and their SQL."""

from veridix.plans import file_queries, run_queries  # noqa: F401  they register their queries
from veridix.plans.answer_queries import ORACLE as _THIRD
from veridix.plans.oracle import ORACLE as _FIRST
from veridix.plans.queries import QUERIES
from veridix.plans.run_oracle import ORACLE as _SECOND

ORACLE = _FIRST | _SECOND | _THIRD

__all__ = ["ORACLE", "QUERIES"]
