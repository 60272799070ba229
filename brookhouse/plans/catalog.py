"""All registered queries."""

from . import change_queries, order_queries, text_queries, visitor_queries  # noqa: F401
from . import stream_queries, topic_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
