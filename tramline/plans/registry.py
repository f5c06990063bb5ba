"""All queries of the telemetry operators."""

from __future__ import annotations

from tramline.plans import alerting, features, health, lake, streams, trajectories
from tramline.plans.base import ORACLES, QUERIES, Query

MODULES = (alerting, features, health, lake, streams, trajectories)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
