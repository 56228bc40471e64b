"""All registered queries."""

from lakelog.plans import catalog_queries, log_queries, runlog_queries, search_queries  # noqa: F401
from lakelog.plans.registry import ORACLE, QUERIES  # noqa: F401
