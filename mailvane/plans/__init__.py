"""All registered queries; importing the modules fills the registry."""

from mailvane.plans import mail_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from mailvane.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
