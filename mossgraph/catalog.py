"""All queries of the engine by name, with the SQL that says the same where SQL can."""

from .plans import analytic_queries, feed_queries, knowledge_queries, log_queries, provider_queries, read_queries, resolve_queries, rollback_queries, text_queries, wording_queries, workingset_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
