"""Batches whose tasks outgrow their alerts are written by the tasks that make them."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from klaxon.operators.matching import match_alerts
from klaxon.plans import adapter as A
from klaxon.schemas import NOTIFICATION_TASK
from klaxon.sources import logs
from klaxon.streaming import jobs

OPEN = "spark.sql.maxConcurrentOutputFileWriters"
EVENT = "event_id string, region_id string, event_type string, status string, severity string, event_timestamp timestamp"


def tables(spark):
    severities = ("INFO", "CRITICAL", "WARNING")
    alerts = [(f"e-{i}", f"R{i % 3}", "AIR", "ACTIVE", severities[i % 3], None) for i in range(30)]
    events = spark.createDataFrame(alerts, EVENT).withColumn("event_timestamp", A.as_of())
    people = [(i, f"u{i}", ("DISCORD", "NTFY", "FAX")[i % 3], f"t{i}", f"R{i % 4}", None, i % 5 > 0) for i in range(50)]
    shape = "id long, user_id string, channel string, recipient_address string, region_id string, min_severity string, active boolean"
    return events, spark.createDataFrame(people, shape)


def test_rows_are_neither_shuffled_nor_left_long(spark, tmp_path):
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("task_id"), (F.col("id") % 2).alias("channel"))
    path = str(tmp_path / "queue")
    jobs.overwrite_batch(rows.repartition(5), path, jobs.Batch("run", 0), "channel", in_place=True)
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(files) == 5 * 2  # a file of each task and folder
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert spark.conf.get(OPEN, None) is None
    assert spark.read.parquet(path).select("task_id").distinct().count() == 3000


def test_large_and_small_batches_queue_the_same(spark, tmp_path, monkeypatch):
    events, subscriptions = tables(spark)
    log = str(tmp_path / "log")
    logs.write_log_files(logs.encode_alerts(A.with_lineage(events)), log, logs.RAW_ALERTS)
    wanted = match_alerts(events, subscriptions, A.as_of()).filter("channel <> 'FAX'")
    wanted = sorted(tuple(r) for r in wanted.select("task_id", "channel", "message").collect())
    assert len(wanted) > 50
    placed = []
    write = jobs.overwrite_batch
    monkeypatch.setattr(jobs, "overwrite_batch", lambda *a, **b: (placed.append(b.get("in_place")), write(*a, **b)))
    for most in (0, 10**9):
        at = lambda name, most=most: str(tmp_path / f"{name}-{most}")
        monkeypatch.setattr(jobs, "SHUFFLED_TASKS", most)
        stream = logs.read_log_files(spark, log, streaming=True)
        job = jobs.archive_and_match(
            stream, lambda: subscriptions, at("history"), at("queue"), at("bad"), at("checkpoint"), A.as_of()
        )
        assert job.awaitTermination(300) and job.exception() is None
        queued = jobs.read_batches(spark, at("queue"), NOTIFICATION_TASK)
        assert sorted(tuple(r) for r in queued.select("task_id", "channel", "message").collect()) == wanted
        # What no queue takes is set aside in both.
        assert spark.read.schema("reason string, row string").parquet(at("bad")).count() > 0
    assert placed.count(True) == 1 and placed.count(False) == 1
