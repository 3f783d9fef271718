"""All registered queries; importing the operators registers them."""

from tessera.functions import tokens  # noqa: F401
from tessera.operators import assemble, cells, chunking, dashboard, evaluation, html, intervals, keys, lookups, phrases, records, reports, retrieval, statistics, vectors, views  # noqa: F401
from tessera.plans.registry import QUERIES, SQL
from tessera.streaming import incremental  # noqa: F401

__all__ = ["QUERIES", "SQL"]
