"""All queries of the engine's own operators."""

from . import dom_queries, evidence_queries, geometry_queries, job_queries, lookup_queries, program_queries, record_queries, relation_queries, semantic_queries, source_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
