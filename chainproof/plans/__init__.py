"""Registered queries of the library's own operators."""

from chainproof.plans import audit_query as _audit_query  # noqa: F401  registers its query
from chainproof.plans import chain_queries as _chain_queries  # noqa: F401  registers its queries
from chainproof.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
