"""Threat score parameters and the shared predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreConfig:
    """Fixed values as defaults: chain window, chain size, score cap and bonuses."""

    window_seconds: int = 300
    min_events: int = 2
    max_score: int = 100
    source_bonus: int = 10
    success_bonus: int = 15


# Parts of an endpoint that mark an attack or a data access.
TRAVERSAL_PARTS = ["../", "/etc/"]
ATTACK_PARTS = ["../", "/etc/", "UNION"]
DATA_PARTS = ["/api/users", "/api/data", "/export"]


def endpoint_has(parts: list[str], endpoint: Column | None = None) -> Column:
    endpoint = F.col("endpoint") if endpoint is None else endpoint
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(endpoint, F.lit(part))
    return F.coalesce(hit, F.lit(False))


def answered_ok() -> Column:
    return F.coalesce(F.col("status_code") == 200, F.lit(False))


def successful_attack() -> Column:
    return answered_ok() & endpoint_has(ATTACK_PARTS)
