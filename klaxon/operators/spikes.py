"""Per-region sliding counts and spike detection with cooldown.

The count at an alert covers the closed range [its ms - window, its ms] of its region.
Members of a window are distinct (alert id, ms) pairs; among alerts of one region at one
ms, those with the smaller id come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from klaxon.functions import columns as C
from klaxon.operators.gate import passing_instants
from klaxon.operators.running import sliding_totals

WINDOW_MS = 5 * 60_000
THRESHOLD = 3
COOLDOWN_MS = 10 * 60_000
ANOMALY_TYPE = "RAPID_FIRE_SPIKE"
ANOMALY_SEVERITY = "CRITICAL"

# A tie is one region at one ms.  It is split once it holds more than 1/TIE_SHARES of all
# members (so there are at most TIE_SHARES such ties) and more than TIE_ROWS rows.
TIE_SHARES = 1000
TIE_ROWS = 1_000_000
TIE_PARTS = 64


def _members(alerts: DataFrame, at: str) -> DataFrame:
    return (
        alerts.filter(F.col("region_id").isNotNull() & F.col(at).isNotNull())
        .select("region_id", "event_id", F.unix_millis(at).alias("ms"))
        .distinct()
    )


def _ties(members: DataFrame) -> DataFrame:
    """(region_id, ms, ties): members at that ms."""
    return members.groupBy("region_id", "ms").agg(F.count("*").alias("ties"))


def _live(ties: DataFrame, window_ms: int) -> DataFrame:
    """Add `before`: members earlier in the window that ends at that ms."""
    totals = sliding_totals(ties, ["region_id"], "ms", "ties", window_ms)
    return totals.select("region_id", "ms", "ties", (F.col("total") - F.col("ties")).alias("before"))


def sliding_counts(
    alerts: DataFrame,
    window_ms: int = WINDOW_MS,
    at: str = "event_timestamp",
    tie_rows: int = TIE_ROWS,
    tie_shares: int = TIE_SHARES,
) -> DataFrame:
    """(region_id, event_id, ms, n): the count each member sees when it arrives."""
    members = _members(alerts, at)
    ties = _ties(members)
    live = _live(ties, window_ms)
    cuts = _tie_cuts(members, ties, tie_rows, tie_shares)

    # Members of an oversized tie get the part of it they sort into; all others part 0.
    # The cuts are at most TIE_SHARES rows, so they may be broadcast.
    tie = ["region_id", "ms"]
    parted = members.join(F.broadcast(cuts), tie, "left").select(
        *tie,
        "event_id",
        F.coalesce(
            F.size(F.filter("cuts", lambda cut: cut <= F.col("event_id"))), F.lit(0)
        ).alias("part"),
        F.col("cuts").isNotNull().alias("split"),
    )
    part_sizes = parted.filter("split").groupBy(*tie, "part").agg(F.count("*").alias("_rows"))
    lower_parts = Window.partitionBy(*tie).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = part_sizes.select(
        *tie, "part", F.coalesce(F.sum("_rows").over(lower_parts), F.lit(0)).alias("shift")
    )
    # Parts are bounded too: TIE_SHARES * (TIE_PARTS + 1) rows.
    bases = (
        live.join(F.broadcast(shifts), tie, "left")
        .select(
            *tie,
            F.coalesce("part", F.lit(0)).alias("part"),
            (F.col("before") + F.coalesce("shift", F.lit(0))).alias("base"),
        )
    )
    order = Window.partitionBy(*tie, "part").orderBy("event_id")
    return (
        parted.withColumn("_nth", F.row_number().over(order))
        .join(bases, [*tie, "part"])
        .select("region_id", "event_id", "ms", (F.col("base") + F.col("_nth")).alias("n"))
    )


def _tie_cuts(members: DataFrame, ties: DataFrame, tie_rows: int, tie_shares: int) -> DataFrame:
    """Up to TIE_PARTS ids that cut each oversized tie into even, ordered parts.

    The ids come from a bounded sample chosen by hash, so a retried task picks the same.
    """
    total = ties.select(F.sum("ties").alias("total")).scalar()
    oversized = ties.filter(F.col("ties") > F.lit(tie_rows)).filter(
        F.col("ties") * F.lit(tie_shares) > total
    ).select("region_id", "ms")
    by_hash = Window.partitionBy("region_id", "ms").orderBy(F.xxhash64("event_id"))
    sample = (
        members.join(F.broadcast(oversized), ["region_id", "ms"], "left_semi")
        .withColumn("_nth", F.row_number().over(by_hash))
        .filter(F.col("_nth") <= TIE_PARTS)
    )
    return sample.groupBy("region_id", "ms").agg(F.sort_array(F.collect_list("event_id")).alias("cuts"))


def spike_candidates(
    alerts: DataFrame, window_ms: int = WINDOW_MS, threshold: int = THRESHOLD, at: str = "event_timestamp"
) -> DataFrame:
    """Members whose count reaches the threshold."""
    return sliding_counts(alerts, window_ms, at).filter(F.col("n") >= _threshold(threshold))


def detect_spikes(
    alerts: DataFrame,
    window_ms: int = WINDOW_MS,
    threshold: int = THRESHOLD,
    cooldown_ms: int = COOLDOWN_MS,
    enabled: bool = True,
    at: str = "event_timestamp",
) -> DataFrame:
    """Anomaly events: candidates that pass the region's cooldown, strictly after its end.

    Suppressed alerts stay in the window and firing does not reset it.  At most one alert
    per (region, ms) can fire, the first to reach the threshold there; so the search runs
    on counts per ms, and ids are looked up for the firing instants only.
    """
    threshold = _threshold(threshold)
    if not enabled:
        alerts = alerts.filter(F.lit(False))
    members = _members(alerts, at)
    live = _live(_ties(members), window_ms)
    candidates = live.filter(F.col("before") + F.col("ties") >= threshold).select(
        "region_id", "ms", F.greatest(F.lit(1), F.lit(threshold) - F.col("before")).alias("fires"), "before"
    )
    hold = max(cooldown_ms, 0) + 1
    firing = passing_instants(candidates, ["region_id"], "ms", hold, payload=["fires", "before"])

    # `fires` never exceeds the threshold, so that many ids per instant are enough; tasks
    # keep no more of an instant before the shuffle that brings its ids together.
    order = Window.partitionBy("region_id", "ms").orderBy("event_id")
    smallest = members.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= threshold)
    fired = smallest.join(firing, ["region_id", "ms"]).filter(F.col("_nth") == F.col("fires"))
    return to_anomalies(
        fired.select(
            "region_id",
            "event_id",
            (F.col("before") + F.col("fires")).alias("n"),
            F.timestamp_millis("ms").alias("detected_at"),
        ),
        window_ms,
        threshold,
    )


def to_anomalies(fired: DataFrame, window_ms: int, threshold: int) -> DataFrame:
    """Anomaly events from (region_id, event_id, n, detected_at)."""
    seconds = window_ms // 1000
    return fired.select(
        C.content_id(F.lit("anomaly"), "region_id", "event_id", C.instant_text("detected_at"), F.lit(window_ms)).alias(
            "anomaly_id"
        ),
        "region_id",
        F.lit(ANOMALY_TYPE).alias("anomaly_type"),
        C.spike_description("region_id", "n", seconds, threshold).alias("description"),
        F.col("n").cast("int").alias("event_count"),
        F.lit(seconds).cast("long").alias("window_duration_seconds"),
        F.lit(ANOMALY_SEVERITY).alias("severity"),
        "detected_at",
        F.array("event_id").alias("triggering_event_ids"),
    )


def _threshold(threshold: int) -> int:
    return threshold if threshold > 0 else THRESHOLD
