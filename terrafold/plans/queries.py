"""All registered queries of the engine's own operators."""

from __future__ import annotations

from terrafold.plans import live_queries, map_queries, model_queries, more_queries, point_queries, stream_queries  # noqa: F401
from terrafold.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
