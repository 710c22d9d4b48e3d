import json

from pyspark.sql import functions as F

from klaxon.operators import history
from klaxon.operators.debounce import debounce
from klaxon.operators.matching import match_alerts, match_anomalies
from klaxon.operators.spikes import detect_spikes
from klaxon.plans import adapter as A
from klaxon.schemas import ALERT_EVENT, LOG_RECORD, NOTIFICATION_TASK, UNRECOGNIZED_LOCATION
from klaxon.sources import feeds, logs
from klaxon.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
HOUR = 3_600_000


def done(query):
    assert query.awaitTermination(300)
    assert query.exception() is None


def keys(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_poll_to_log(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    body = F.struct("id", F.when(F.col("id") == 7, F.lit("Nowhere ")).otherwise(F.col("location_title")).alias("location_title"), "started_at", "alert_type")
    snapshots = A.raw_alerts(spark, FOLDER).groupBy((F.col("id") / 100).cast("long").alias("poll")).agg(
        F.collect_list(body).alias("alerts")
    )
    snapshots.select("alerts").repartition(3).write.json(at("polls"))
    mappings = lambda: A.mappings(spark, FOLDER)
    polls = feeds.read_snapshots(spark, at("polls"), streaming=True)
    done(jobs.intake(polls, mappings, at("events"), at("found"), at("cp1"), A.as_of()))
    events = jobs.read_batches(spark, at("events"), ALERT_EVENT)
    assert events.filter("region_id = 'NOWHERE_REGION'").count() == 1
    assert keys(events.filter("region_id <> 'NOWHERE_REGION'"), "event_id", "region_id") == keys(
        A.alerts(spark, FOLDER).filter("event_id <> 'alerts-in-ua-7'"), "event_id", "region_id"
    )
    found = jobs.read_batches(spark, at("found"), UNRECOGNIZED_LOCATION)
    assert keys(found, "raw_title", "occurrences_count") == [("Nowhere", 1)]

    stream = jobs.read_batches(spark, at("events"), ALERT_EVENT, streaming=True)
    done(jobs.debounced_log(stream, at("log"), at("late"), at("cp2"), HOUR))
    kept = logs.decode_alerts(logs.read_log_files(spark, at("log")))
    assert keys(kept, "event_id") == keys(debounce(events, HOUR), "event_id")

    # The job's own log is archived whole, and each record has its own offset.
    log = logs.read_log_files(spark, at("log"), streaming=True)
    subs = A.subscriptions(spark, FOLDER)
    done(jobs.archive_and_match(log, lambda: subs, at("history"), at("queue"), at("bad"), at("cp3"), A.as_of()))
    stored = history.read_alert_history(spark, at("history"))
    assert keys(stored, "event_id") == keys(kept, "event_id")
    assert stored.select("kafka_partition", "kafka_offset").distinct().count() == stored.count()
    assert spark.read.schema("reason string, row string").parquet(at("bad")).isEmpty()
    tasks = jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK)
    assert keys(tasks, "task_id") == keys(match_alerts(kept, subs, A.as_of()), "task_id")


def test_log_to_outbox(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    alerts = A.alerts(spark, FOLDER).cache()
    subs = A.subscriptions(spark, FOLDER)
    log = logs.as_log_records(logs.encode_alerts(A.with_lineage(alerts)), logs.RAW_ALERTS)
    broken = spark.createDataFrame([("events.raw-alerts", 0, 1, "k", "{not json"), ("t", 0, 2, "k", None)], LOG_RECORD)
    torn = spark.createDataFrame(
        [("t", 0, 3, None, json.dumps({"eventId": "x", "regionId": "NATION_1_REGION", "severity": "INFO"}))], LOG_RECORD
    )
    log.unionByName(broken).unionByName(torn).repartition(3).write.parquet(at("log"))

    source = logs.read_log_files(spark, at("log"), streaming=True, files_per_batch=1)
    matching = lambda cp, run="run": jobs.archive_and_match(
        source, lambda: subs, at("history"), at("queue"), at("bad"), at(cp), A.as_of(), run_id=run
    )
    done(matching("cp1"))
    stored = history.read_alert_history(spark, at("history"))
    assert keys(stored, "event_id", "kafka_offset") == keys(A.with_lineage(alerts), "event_id", "offset")
    tasks = jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK)
    assert tasks.filter("event_id = 'x'").isEmpty()
    want = match_alerts(alerts, subs, A.as_of())
    assert tasks.count() == want.count()
    assert keys(tasks.filter("event_id <> 'x'"), "task_id", "message") == keys(want, "task_id", "message")
    reasons = spark.read.parquet(at("bad")).groupBy("reason").count()
    assert dict(map(tuple, reasons.collect())) == {"malformed record": 2, "incomplete history row": 1}

    # The same batches again, as after a lost commit: nothing is doubled.
    before = (stored.count(), tasks.count())
    done(matching("cp-again"))
    again = history.read_alert_history(spark, at("history")), jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK)
    assert tuple(t.count() for t in again) == before

    # Another run adds to what is there.
    done(matching("cp-other", "other"))
    assert history.read_alert_history(spark, at("history")).count() == 2 * before[0]

    queue = jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK, streaming=True)
    done(jobs.deliver(queue, at("outbox"), at("late"), at("cp2"), "https://push.example.org", "all", None, "desk"))
    sent = spark.read.parquet(at("outbox"))
    assert sent.count() == before[1] and sent.filter("status <> 'DRY_RUN'").count() == 0


def test_log_to_anomaly_tasks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    alerts = A.alerts(spark, FOLDER).cache()
    subs = A.subscriptions(spark, FOLDER)
    logs.write_log_files(logs.encode_alerts(A.with_lineage(alerts)), at("log"), logs.RAW_ALERTS)
    config = (24 * HOUR, 3, 30 * HOUR)
    source = logs.read_log_files(spark, at("log"), streaming=True)
    done(jobs.analyse(source, at("anomalies"), at("history"), at("cp1"), *config))
    want = detect_spikes(alerts, *config)
    stored = history.read_anomaly_history(spark, at("history"))
    assert keys(stored, "anomaly_id", "event_count") == keys(want, "anomaly_id", "event_count")
    published = jobs.read_batches(spark, at("anomalies"), LOG_RECORD, streaming=True)
    done(jobs.dispatch_anomalies(published, lambda: subs, at("queue"), at("bad"), at("cp2"), A.as_of()))
    tasks = jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK)
    assert keys(tasks, "task_id", "message") == keys(match_anomalies(want, subs, A.as_of()), "task_id", "message")
