"""Imports every module that registers queries."""

from claimlens.plans import relational_queries, search_queries, text_queries  # noqa: F401
from claimlens.plans.registry import QUERIES, SQL  # noqa: F401
