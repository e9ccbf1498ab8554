"""All queries of the library."""

from . import aggregate_queries, geometry_queries, join_queries, loader_queries, store_queries, task_queries, text_queries, udf_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
