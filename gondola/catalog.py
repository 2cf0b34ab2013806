"""All registered queries of the shelf operators, and their DuckDB twins."""

from gondola.plans import code_queries, evaluation_queries, geometry_queries, io_queries, match_queries, planogram_queries, review_queries, stream_queries  # noqa: F401
from gondola.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
