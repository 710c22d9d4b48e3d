"""Debounce of repeated alerts per (region, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klaxon.operators.gate import ttl_gate

DEBOUNCE_TTL_MS = 3_600_000
KEYS = ["region_id", "event_type"]


def debounce(
    alerts: DataFrame,
    ttl_ms: int | None = DEBOUNCE_TTL_MS,
    at: str = "event_timestamp",
    ended: DataFrame | None = None,
) -> DataFrame:
    """Alerts to publish: one per (region, type) and TTL, the TTL counted from that alert.

    Rows without region or type are dropped.  A TTL of none, zero or less passes the rest.
    `ended` (region_id, event_type, `at`) marks where an alert ended: from that instant the
    pair is free again.
    """
    if not ttl_ms or ttl_ms <= 0:
        return alerts.filter(F.col("region_id").isNotNull() & F.col("event_type").isNotNull())
    timed = alerts.withColumn("_at", F.unix_millis(at))
    resets = None if ended is None else ended.select(*KEYS, F.unix_millis(at).alias("_at"))
    return ttl_gate(timed, KEYS, "_at", ttl_ms, ties=["event_id"], inclusive=True, resets=resets).drop("_at")
