"""Named queries over the tables, with the SQL that states the same."""

from tessera.plans import acceptance_queries, document_queries, function_queries, sequence_queries, session_queries  # noqa: F401
from tessera.plans import history_queries, motion_queries, stream_queries  # noqa: F401
from tessera.plans.registry import QUERIES

__all__ = ["QUERIES"]
