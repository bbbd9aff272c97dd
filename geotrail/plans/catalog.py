"""All registered queries (importing the modules registers them)."""

from geotrail.plans import (both_queries, cleaning_queries, evaluation_queries, function_queries,  # noqa: F401
                            graph_queries, home_queries, increment_queries, ingest_queries, link_queries,
                            mobility_queries, stream_queries)
from geotrail.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
