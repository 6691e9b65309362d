"""All registered queries."""

from knotwork.plans import graph_queries, stored_queries, text_queries  # noqa: F401
from knotwork.plans.registry import QUERIES, SQL  # noqa: F401
