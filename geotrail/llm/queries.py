"""All registered queries (importing the modules registers them)."""

from geotrail.llm import corpus_queries, page_queries, text_queries, vector_queries  # noqa: F401
from geotrail.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
