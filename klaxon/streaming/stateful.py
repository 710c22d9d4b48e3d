"""Streaming forms of the debounce, the task deduplication and the spike detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from klaxon.operators import spikes
from klaxon.operators.debounce import DEBOUNCE_TTL_MS, KEYS
from klaxon.operators.delivery import IDEMPOTENCY_TTL_MS
from klaxon.streaming.processors import (
    GateProcessor,
    SpikeProcessor,
    counted_per_instant,
    first_per_instant,
)

DELAY_MS = 10 * 60_000


def _delay(ms: int) -> str:
    return f"{ms} milliseconds"


def gate_stream(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    ttl_ms: int,
    ties: Sequence[str] = (),
    inclusive: bool = True,
    delay_ms: int = DELAY_MS,
) -> DataFrame:
    """Streaming ``ttl_gate``: its rows, and late ones, told apart by the column `late`.

    A row is late if it is older than the watermark, `delay_ms` behind the newest row.
    Of the late rows of a key at one ms, one stands for all.
    """
    keys, ties = list(keys), list(ties)
    present = F.col(time).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    rows = rows.filter(present)
    if ttl_ms <= 0:
        return rows.withColumn("late", F.lit(False))
    timed = rows.withColumn("_at", F.unix_millis(time))
    # The watermark is set before the fold, so late rows still reach the state and are named.
    thin = timed.withWatermark(time, _delay(delay_ms)).mapInArrow(
        lambda b: first_per_instant(b, keys, "_at", ties), timed.schema
    )
    shape = StructType([*timed.schema.fields, StructField("late", BooleanType())])
    hold = ttl_ms if inclusive else ttl_ms + 1
    judged = thin.groupBy(*keys).transformWithState(GateProcessor("_at", ties, hold), shape, "Append", "EventTime")
    return judged.drop("_at")


def debounce_stream(
    alerts: DataFrame, ttl_ms: int = DEBOUNCE_TTL_MS, delay_ms: int = DELAY_MS, keep_late: bool = False
) -> DataFrame:
    judged = gate_stream(alerts, KEYS, "event_timestamp", ttl_ms, ["event_id"], delay_ms=delay_ms)
    return judged if keep_late else _on_time(judged)


def dedup_stream(
    tasks: DataFrame, ttl_ms: int = IDEMPOTENCY_TTL_MS, delay_ms: int = DELAY_MS, keep_late: bool = False
) -> DataFrame:
    judged = gate_stream(tasks, ["task_id"], "created_at", ttl_ms, delay_ms=delay_ms)
    return judged if keep_late else _on_time(judged)


def _on_time(judged: DataFrame) -> DataFrame:
    return judged.filter(~F.col("late")).drop("late")


def spikes_stream(
    alerts: DataFrame,
    window_ms: int = spikes.WINDOW_MS,
    threshold: int = spikes.THRESHOLD,
    cooldown_ms: int = spikes.COOLDOWN_MS,
    delay_ms: int = DELAY_MS,
) -> DataFrame:
    """Streaming ``detect_spikes``: anomaly events, at ms resolution.

    Repeats of an alert id at one ms are dropped first, keyed by the alert and so without
    hot keys; only then are counts brought together per region.
    """
    threshold = threshold if threshold > 0 else spikes.THRESHOLD
    shape = StructType(
        [
            StructField("region_id", StringType()),
            StructField("ms", LongType()),
            StructField("rows", LongType()),
            StructField("ids", ArrayType(StringType())),
        ]
    )
    found = StructType(
        [
            StructField("region_id", StringType()),
            StructField("ms", LongType()),
            StructField("event_id", StringType()),
            StructField("n", LongType()),
        ]
    )
    members = (
        alerts.filter(F.col("region_id").isNotNull() & F.col("event_timestamp").isNotNull())
        .select("region_id", "event_id", F.unix_millis("event_timestamp").alias("ms"), "event_timestamp")
        .withWatermark("event_timestamp", _delay(delay_ms))
        .dropDuplicatesWithinWatermark(["region_id", "event_id", "ms"])
    )
    fired = (
        members.mapInArrow(lambda b: counted_per_instant(b, threshold), shape)
        .groupBy("region_id")
        .transformWithState(SpikeProcessor(window_ms, threshold, cooldown_ms, delay_ms), found, "Append", "EventTime")
    )
    return spikes.to_anomalies(
        fired.select("region_id", "event_id", "n", F.timestamp_millis("ms").alias("detected_at")), window_ms, threshold
    )


def rows_dropped_late(progress: dict) -> int:
    """Rows a progress report counts as later than the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in progress.get("stateOperators", []))
