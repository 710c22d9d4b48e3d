"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local cores.  Every result is produced in full and discarded by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from klaxon.plans.queries import QUERIES  # noqa: E402
from klaxon.session import fresh_path, local_session  # noqa: E402

HEADLINE = [
    "snapshot_to_events",
    "normalize_regions",
    "discover_unrecognized",
    "alert_log_decode",
    "debounce_alerts",
    "debounce_with_clear",
    "sliding_counts",
    "detect_spikes",
    "match_anomalies",
    "match_alerts",
    "resolve_attempts",
    "subs_changes",
    "add_mappings",
    "archive_alerts",
    "alert_history_between",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def stream_spikes(spark, folder: str) -> None:
    """Streaming spike detection over the alert table as one file source."""
    from klaxon.plans import adapter
    from klaxon.streaming.stateful import spikes_stream

    source = fresh_path(spark, "bench-alerts")
    alerts = adapter.alerts(spark, folder)
    alerts.write.parquet(source)
    stream = spark.readStream.schema(alerts.schema).parquet(source)
    query = (
        spikes_stream(stream, 6 * 3_600_000, 6, 24 * 3_600_000)
        .writeStream.format("noop")
        .option("checkpointLocation", fresh_path(spark, "bench-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cores, shuffle_partitions=cores, memory="16g")
    # Warm the JVM and the Python workers on the smallest query; not part of any figure.
    QUERIES["debounce_alerts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        seconds[name] = timed(lambda n=name: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save())
        print(name, seconds[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        seconds["stream_detect_spikes"] = timed(lambda: stream_spikes(spark, folder))
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
