"""All queries of the engine, by name."""

from gleanery.plans import cleaning_queries, dataset_queries, markup_queries, page_queries, record_queries, relational_queries, small_queries  # noqa: F401
from gleanery.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
