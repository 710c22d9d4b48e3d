"""The streaming jobs: poll intake, archive and match, analysis, anomaly dispatch, delivery.

Each job is its own query with its own checkpoint, so the consumers of a log do not wait
for each other.  A job with several outputs writes them per micro-batch under (`run_id`,
`batch_id`) partitions and commits each when it is whole; another checkpoint adds to them.  The
next job reads committed batches, so a replay gives it nothing twice (`sources/commits.py`).  Ids
are hashes of content, so a replayed batch has the same rows.  Dimension and subscription tables
are read anew for every micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from klaxon.operators import delivery, history, matching, regions
from klaxon.operators.debounce import DEBOUNCE_TTL_MS
from klaxon.operators.spikes import COOLDOWN_MS, THRESHOLD, WINDOW_MS
from klaxon.schemas import ALERT_EVENT, ALERT_JSON, ANOMALY_JSON, UNRECOGNIZED_LOCATION
from klaxon.sources import commits, feeds, logs
from klaxon.streaming import ordered as in_order
from klaxon.streaming import stateful

Table = Callable[[], DataFrame]


class Batch(NamedTuple):
    """A micro-batch of a run.  A checkpoint is a run: replays keep it, a new one has other rows."""

    run_id: str
    number: int


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of this checkpoint: a new checkpoint at an old path is a new run."""
    metadata = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return json.loads(metadata)["id"]


# A batch that may have more tasks than this is written where its tasks are made; below, a shuffle merges small files.
SHUFFLED_TASKS = 1_000_000
# Files that a task may have open at once; with more folders than these Spark sorts the rest by folder.
OPEN_FILES = 8
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def overwrite_batch(rows: DataFrame, path: str, batch: Batch, *partitions: str, in_place: bool = False) -> None:
    """Write and commit one micro-batch's rows, once in its run; what an attempt left is replaced.

    `in_place` is for rows that outgrow what they are made from: they are written by the tasks that
    make them, neither shuffled nor sorted by folder, so nothing but the table itself is on disk.
    Ids are hex digits, which zstd halves and snappy leaves as long as they are.
    """
    if commits.is_committed(path, batch.run_id, batch.number):
        return
    placed = rows.withColumn("run_id", F.lit(batch.run_id)).withColumn("batch_id", F.lit(batch.number))
    with _open_files(rows.sparkSession, in_place):
        (
            (placed if in_place else placed.hint("rebalance", *partitions))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("run_id", "batch_id", *partitions)
            .parquet(path)
        )
    commits.commit_batch(path, batch.run_id, batch.number)


@contextmanager
def _open_files(spark: SparkSession, several: bool) -> Iterator[None]:
    """Let a task write to OPEN_FILES folders at once, so that Spark needn't sort its rows by folder."""
    before = spark.conf.get(_OPEN_FILES, None)
    if several:
        spark.conf.set(_OPEN_FILES, str(OPEN_FILES))
    try:
        yield
    finally:
        if several and before is None:
            spark.conf.unset(_OPEN_FILES)
        elif several:
            spark.conf.set(_OPEN_FILES, before)


def _outgrow(events: DataFrame, subscriptions: DataFrame) -> bool:
    """Whether the tasks of these may be too many to be shuffled."""
    return events.count() * subscriptions.count() > SHUFFLED_TASKS


def _start(
    stream: DataFrame, work, checkpoint: str, name: str, once: bool, run_id: str | None = None
) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        batch_id = Batch(run_id or run_of(rows.sparkSession, checkpoint), number)
        rows.persist()
        try:
            work(rows, batch_id)
        finally:
            rows.unpersist()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def intake(
    snapshots: DataFrame,
    mappings: Table,
    log_path: str,
    discovery_path: str,
    checkpoint: str,
    as_of: Column | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Exploded feed alerts to alert events in `log_path`; unknown titles to `discovery_path`.

    The events are not debounced here: `debounced_log` does that on keyed state.
    """

    def work(rows: DataFrame, batch_id: Batch) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        known = mappings()
        overwrite_batch(feeds.snapshot_to_events(rows, known, now), log_path, batch_id)
        seen = rows.withColumn("_seen", now)
        fresh = regions.discover_unrecognized(seen, known, "location_title", "_seen")
        overwrite_batch(fresh, discovery_path, batch_id)

    return _start(snapshots, work, checkpoint, "intake", once)


def debounced_log(
    events: DataFrame,
    log_path: str,
    late_path: str,
    checkpoint: str,
    ttl_ms: int = DEBOUNCE_TTL_MS,
    delay_ms: int = stateful.DELAY_MS,
    once: bool = True,
    ordered: bool = False,
    ended: DataFrame | None = None,
    slot_ms: int = in_order.SLOT_MS,
) -> StreamingQuery:
    """Polled events through the debounce into the alert log; late ones aside.

    With `ordered` rows wait for the watermark and are judged in order of event time; `ended`
    (region_id, event_type, event_timestamp) is then a stream of where alerts have ended.
    """

    def work(rows: DataFrame, batch_id: Batch) -> None:
        on_time, late = _split_late(rows)
        overwrite_batch(_log_records(logs.encode_alerts(on_time), logs.RAW_ALERTS, log_path, batch_id), log_path, batch_id)
        overwrite_batch(late, late_path, batch_id)

    if ordered:
        judged = in_order.ordered_debounce_stream(events, ttl_ms, ended, delay_ms, slot_ms).drop("ended")
    else:
        judged = stateful.debounce_stream(events, ttl_ms, delay_ms, keep_late=True)
    return _start(judged, work, checkpoint, "debounced_log", once)


def _log_records(encoded: DataFrame, topic: str, log_path: str, batch: Batch) -> DataFrame:
    run = commits.run_number(log_path, batch.run_id)
    return logs.as_log_records(encoded, topic, batch_id=batch.number, run=run)


def _split_late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(~F.col("late")).drop("late"), rows.filter("late").drop("late")


def archive_and_match(
    log: DataFrame,
    subscriptions: Table,
    history_path: str,
    queue_path: str,
    quarantine_path: str,
    checkpoint: str,
    as_of: Column | None = None,
    once: bool = True,
    run_id: str | None = None,
) -> StreamingQuery:
    """Alert log to history and to routed tasks; what cannot be read or stored is quarantined."""

    def work(records: DataFrame, batch_id: Batch) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        # Archive first: what can't be stored isn't matched either.
        complete, incomplete = history.split_incomplete(history.to_alert_history(logs.decode_alerts(records), now))
        history.write_days(complete, history_path, "event_timestamp", batch_id=batch_id.number, run_id=batch_id.run_id)
        known = subscriptions()
        routed, rejected = delivery.route_tasks(matching.match_alerts(complete.select(*ALERT_EVENT.names), known, now))
        overwrite_batch(routed, queue_path, batch_id, "channel", in_place=_outgrow(complete, known))
        _, broken = logs.split_malformed(records, ALERT_JSON)
        reasons = (
            broken.select(F.lit("malformed record").alias("reason"), F.to_json(F.struct("*")).alias("row"))
            .unionByName(_refused(incomplete, "incomplete history row"))
            .unionByName(_refused(rejected, "no queue for channel"))
        )
        overwrite_batch(reasons, quarantine_path, batch_id)

    return _start(log, work, checkpoint, "archive_and_match", once, run_id)


def _refused(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select(F.lit(reason).alias("reason"), F.to_json(F.struct("*")).alias("row"))


def analyse(
    log: DataFrame,
    anomaly_log_path: str,
    history_path: str,
    checkpoint: str,
    window_ms: int = WINDOW_MS,
    threshold: int = THRESHOLD,
    cooldown_ms: int = COOLDOWN_MS,
    delay_ms: int = stateful.DELAY_MS,
    once: bool = True,
    late_path: str | None = None,
) -> StreamingQuery:
    """Alert log to anomalies.  They are published first: a failing archive cannot hold them back.

    With `late_path` rows are judged in order of event time, and those that come too late for it
    are written there.
    """
    alerts = logs.decode_alerts(log)
    config = (window_ms, threshold, cooldown_ms, delay_ms)
    spikes = stateful.spikes_stream(alerts, *config) if late_path is None else in_order.ordered_spikes_stream(alerts, *config)

    def work(rows: DataFrame, batch_id: Batch) -> None:
        if late_path is not None:
            rows, late = in_order.split_spikes(rows, window_ms, threshold)
        records = _log_records(logs.encode_anomalies(rows), logs.ANOMALIES, anomaly_log_path, batch_id)
        overwrite_batch(records, anomaly_log_path, batch_id)
        history.write_days(rows, history_path, "detected_at", batch_id=batch_id.number, run_id=batch_id.run_id)
        if late_path is not None:
            overwrite_batch(late, late_path, batch_id)

    return _start(spikes, work, checkpoint, "analyse", once)


def dispatch_anomalies(
    anomaly_log: DataFrame,
    subscriptions: Table,
    queue_path: str,
    quarantine_path: str,
    checkpoint: str,
    as_of: Column | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Anomaly log to routed tasks; what cannot be read or routed is quarantined."""

    def work(records: DataFrame, batch_id: Batch) -> None:
        now = F.current_timestamp() if as_of is None else as_of
        known, anomalies = subscriptions(), logs.decode_anomalies(records)
        routed, rejected = delivery.route_tasks(matching.match_anomalies(anomalies, known, now))
        overwrite_batch(routed, queue_path, batch_id, "channel", in_place=_outgrow(anomalies, known))
        _, broken = logs.split_malformed(records, ANOMALY_JSON)
        reasons = _refused(broken, "malformed record").unionByName(_refused(rejected, "no queue for channel"))
        overwrite_batch(reasons, quarantine_path, batch_id)

    return _start(anomaly_log, work, checkpoint, "dispatch_anomalies", once)


def deliver(
    tasks: DataFrame,
    outbox_path: str,
    late_path: str,
    checkpoint: str,
    server: str,
    default_topic: str,
    default_url: str | None,
    username: str | None,
    dry_run: bool = True,
    once: bool = True,
) -> StreamingQuery:
    """Queued tasks, once per task id and TTL, rendered into the outbox; late ones aside."""

    def work(rows: DataFrame, batch_id: Batch) -> None:
        on_time, late = _split_late(rows)
        rendered = delivery.outbox(on_time, server, default_topic, default_url, username, dry_run)
        overwrite_batch(rendered, outbox_path, batch_id, "channel")
        overwrite_batch(late, late_path, batch_id)

    return _start(stateful.dedup_stream(tasks, keep_late=True), work, checkpoint, "deliver", once)


FOLD = "fold"


def fold_discovery(spark: SparkSession, found_path: str, totals_path: str) -> int:
    """Fold what `intake` found since the last fold into the title statistics; how many commits are in.

    The totals are committed as batch n once the first n commits of `found_path` are in them, so
    a repeat after a failure counts nothing twice.  Only new commits and the last totals are read.
    """
    done = _folded(totals_path)
    numbers = commits.commit_numbers(found_path)
    upto = numbers[-1] + 1 if numbers else 0
    if upto > done:
        files = commits.committed_files(found_path, done, upto)
        fresh = spark.read.schema(UNRECOGNIZED_LOCATION).parquet(*files) if files else None
        totals = read_totals(spark, totals_path)
        merged = totals if fresh is None else regions.merge_unrecognized(totals, _one_per_title(fresh))
        overwrite_batch(merged.select(*UNRECOGNIZED_LOCATION.names), totals_path, Batch(FOLD, upto))
    return upto


def _one_per_title(found: DataFrame) -> DataFrame:
    """The rows of several micro-batches as one per title."""
    return found.groupBy("id", "raw_title").agg(
        F.sum("occurrences_count").alias("occurrences_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def _folded(totals_path: str) -> int:
    numbers = commits.commit_numbers(totals_path)
    return commits.read_commit(totals_path, numbers[-1])["batch_id"] if numbers else 0


def read_totals(spark: SparkSession, totals_path: str) -> DataFrame:
    """The title statistics as last folded."""
    numbers = commits.commit_numbers(totals_path)
    files = commits.committed_files(totals_path, numbers[-1], numbers[-1] + 1) if numbers else []
    if not files:
        return spark.createDataFrame([], UNRECOGNIZED_LOCATION)
    return spark.read.schema(UNRECOGNIZED_LOCATION).parquet(*files)


def read_batches(spark: SparkSession, path: str, schema, streaming: bool = False) -> DataFrame:
    """A table written by `overwrite_batch`: as it stands, or its committed batches as a stream."""
    if streaming:
        return commits.read_committed(spark, path, schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)
