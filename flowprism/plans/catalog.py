"""All registered queries."""

from __future__ import annotations

from flowprism.plans import io_queries, model_queries, packet_queries, table_queries  # noqa: F401
from flowprism.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
