"""The streaming forms as queries: feeds of the driver's tables arrive in several micro-batches.

A feed is written batch by batch in an order of arrival that differs from event time, and the job
is started anew from its checkpoint for every batch.  The last batch holds one row far in the
future, so that the watermark passes all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from klaxon.operators import spikes
from klaxon.operators.history import read_alert_history
from klaxon.plans import adapter as A
from klaxon.plans.queries import HOUR, QUERIES, SPIKE_CONFIGS, _stored_snapshots, query
from klaxon.schemas import LOG_RECORD, NOTIFICATION_TASK
from klaxon.session import fresh_path
from klaxon.sources import feeds
from klaxon.streaming import jobs, ordered

__all__ = ["QUERIES"]

LATENESS = 6 * HOUR
PARTS = 2


def _arrivals(rows: DataFrame, at: Column, key: Column, parts: int = PARTS) -> list[DataFrame]:
    """`rows` in the order of arrival, up to LATENESS ms after `at` (ms), as batches of like time spans."""
    timed = rows.withColumn("_arrives", at + F.pmod(F.xxhash64(key), F.lit(LATENESS)))
    low, high = timed.agg(F.min("_arrives"), F.max("_arrives")).first()
    if low is None:
        return [rows]
    step = (high - low) // parts + 1
    part = F.floor((F.col("_arrives") - low) / step)
    return [timed.filter(part == k).drop("_arrives") for k in range(parts)]


def _drain(
    spark: SparkSession, name: str, batches: list[DataFrame], start: Callable[[DataFrame, int], list[StreamingQuery]]
) -> None:
    """Give the batches to the stream one after the other; `start` starts the jobs on it each time."""
    path = fresh_path(spark, name)
    schema = batches[0].schema
    for k, rows in enumerate(batches):
        jobs.overwrite_batch(rows, path, jobs.Batch("feed", k))
        for done in start(jobs.read_batches(spark, path, schema, streaming=True), k):
            done.awaitTermination()


def _kept(spark: SparkSession, name: str, batches: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of a streaming transformation of the feed."""
    out, checkpoint = fresh_path(spark, f"{name}-out"), fresh_path(spark, f"{name}-checkpoint")
    shape = []

    def start(stream: DataFrame, _: int) -> list[StreamingQuery]:
        result = transform(stream)
        shape[:] = [result.schema]
        # The generator form starts a job only when the one before it is done.
        yield jobs._start(result, lambda rows, batch: jobs.overwrite_batch(rows, out, batch), checkpoint, name, True)

    _drain(spark, name, batches, start)
    return jobs.read_batches(spark, out, shape[0])


def _end(alerts: DataFrame) -> DataFrame:
    """An alert of no region long after all others."""
    newest = alerts.agg(F.expr("max(event_timestamp) + interval 30 days").alias("_at"))
    named = {"event_id": "end-1", "region_id": "END", "event_type": "END"}
    return newest.select(
        *(F.lit(named.get(c)).cast("string").alias(c) if c != "event_timestamp" else F.col("_at").alias(c) for c in alerts.columns)
    )


def _fed(alerts: DataFrame) -> list[DataFrame]:
    return [*_arrivals(alerts, F.unix_millis("event_timestamp"), F.col("event_id")), _end(alerts)]


@query
def stream_late_rows(spark, folder):
    """Spikes of a feed out of order, and the rows that come when their time is over."""
    alerts = A.alerts(spark, folder)
    too_late = A.number_of() % 37 == 0
    _, window, threshold, cooldown = SPIKE_CONFIGS[1]
    found = _kept(
        spark,
        "late-rows",
        [*_fed(alerts.filter(~too_late)), alerts.filter(too_late)],
        lambda s: ordered.ordered_spikes_stream(s, window, threshold, cooldown, LATENESS, LATENESS),
    )
    return found.select("late", "region_id", "event_id", "n")


@query
def stream_debounce_with_clear(spark, folder):
    alerts = A.alerts(spark, folder)
    ends = A.number_of() % 11 == 0
    kept = _kept(
        spark,
        "clear",
        _fed(alerts),
        lambda s: ordered.ordered_debounce_stream(s.filter(~ends), 12 * HOUR, s.filter(ends), LATENESS, LATENESS),
    )
    return kept.filter("not ended").select("late", "event_id")


@query
def stream_snapshot_filter(spark, folder):
    """Polls of three feeds, numbered from 0 in each, that arrive out of order."""
    polls = _stored_snapshots(spark, folder).withColumn("poll", F.floor(F.col("seq") / 3).cast("long"))
    polls = polls.withColumn("polled_at", F.timestamp_seconds(F.col("poll") * 900))
    end = polls.limit(1).withColumn("feed", F.lit("end")).withColumn("polled_at", F.timestamp_seconds(F.lit(10**9)))
    batches = _arrivals(polls, F.unix_millis("polled_at"), F.concat("feed", F.lit("/"), F.col("seq").cast("string")))
    kept = _kept(
        spark,
        "snapshots",
        [*batches, end],
        lambda s: ordered.changed_snapshots_stream(s, "polled_at", seq="poll", delay_ms=LATENESS),
    )
    return kept.select("late", "feed", "seq")


@query
def stream_discovery(spark, folder):
    """Unknown titles of the feed, folded after every batch; each fold is repeated."""
    raw = A.raw_alerts(spark, folder)
    events, found, totals = (fresh_path(spark, f"discovery-{n}") for n in ("events", "found", "totals"))
    checkpoint = fresh_path(spark, "discovery-checkpoint")

    def start(stream, _):
        yield jobs.intake(stream, lambda: A.mappings(spark, folder), events, found, checkpoint, A.as_of())
        jobs.fold_discovery(spark, found, totals)
        jobs.fold_discovery(spark, found, totals)

    _drain(spark, "discovery-feed", _arrivals(raw, F.unix_millis("seen_at"), F.col("id")), start)
    return jobs.read_totals(spark, totals).select("raw_title", "occurrences_count")


@query
def stream_pipeline(spark, folder):
    """Polled alerts through intake, ordered debounce, archive and matching, where one batch is lost and replayed."""
    raw = A.raw_alerts(spark, folder)
    names = ("events", "found", "log", "late", "history", "queue", "quarantine", "cp1", "cp2", "cp3")
    at = {n: fresh_path(spark, f"chain-{n}") for n in names}
    event = A.alerts(spark, folder).schema
    subscriptions = A.subscriptions(spark, folder)
    lost = [True]

    def fetched():
        # The first batch is lost after its history was written, and so comes again.
        if lost:
            lost.pop()
            raise ConnectionError("subscriptions")
        return subscriptions

    def matching():
        log = jobs.read_batches(spark, at["log"], LOG_RECORD, streaming=True)
        return jobs.archive_and_match(
            log, fetched, at["history"], at["queue"], at["quarantine"], at["cp3"], A.as_of()
        )

    def start(stream, _):
        yield jobs.intake(stream, lambda: A.mappings(spark, folder), at["events"], at["found"], at["cp1"], A.as_of())
        polled = jobs.read_batches(spark, at["events"], event, streaming=True)
        yield jobs.debounced_log(polled, at["log"], at["late"], at["cp2"], 12 * HOUR, LATENESS, ordered=True, slot_ms=LATENESS)
        if lost:
            try:
                matching().awaitTermination()
            except StreamingQueryException:
                pass
        yield matching()

    end = raw.agg(F.expr("max(seen_at) + interval 30 days").alias("seen_at")).select(
        F.lit(-1).cast("long").alias("id"), F.lit("end").alias("location_title"),
        F.date_format("seen_at", A.INSTANT).alias("started_at"), F.lit("end").alias("alert_type"), "seen_at",
    )
    _drain(spark, "chain-feed", [*_arrivals(raw, F.unix_millis("seen_at"), F.col("id"), 2), end], start)
    tasks = jobs.read_batches(spark, at["queue"], NOTIFICATION_TASK).groupBy("event_id").agg(F.count(F.lit(1)).alias("tasks"))
    stored = read_alert_history(spark, at["history"]).select("event_id", "region_id")
    return stored.join(tasks, "event_id", "left").select("event_id", "region_id", F.coalesce("tasks", F.lit(0)).alias("tasks"))


@query
def snapshot_quarantine(spark, folder):
    """Stored polls, one JSON line each, some of them cut off; what can be read and what can't."""
    polls = _stored_snapshots(spark, folder).select("seq", F.col("payload").alias("value"))
    cut = F.concat(F.lit('{"alerts":[{"id":'), F.col("seq").cast("string"))
    lines = polls.select(F.when(F.col("seq") % 7 == 3, cut).otherwise(F.col("value")).alias("value"))
    path = fresh_path(spark, "poll-lines")
    lines.write.text(path)
    good, bad = feeds.split_unreadable(feeds.read_snapshot_lines(spark, path))
    read = feeds.explode_alerts(good).select(F.lit("alert").alias("kind"), F.col("id").cast("string").alias("what"))
    return read.unionByName(
        bad.select(F.lit("unreadable").alias("kind"), F.col("text").alias("what"))
    )


@query
def spikes_of_torn_rows(spark, folder):
    """Rows without a region are no members; a detector that is switched off finds nothing."""
    alerts = A.alerts(spark, folder)
    torn = alerts.withColumn("region_id", F.when(A.number_of() % 13 != 0, F.col("region_id")))
    _, window, threshold, cooldown = SPIKE_CONFIGS[1]
    found = spikes.detect_spikes(torn, window, threshold, cooldown)
    off = spikes.detect_spikes(torn, window, threshold, cooldown, enabled=False)
    both = found.unionByName(off)
    return both.select("region_id", F.element_at("triggering_event_ids", 1).alias("event_id"), F.col("event_count").alias("n"))
