"""All queries of the correspondence operators."""

from letterloom.plans import check_queries, stream_queries, table_queries, text_queries  # noqa: F401
from letterloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
