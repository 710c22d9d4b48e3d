import os

import pytest

from klaxon.operators.debounce import debounce
from klaxon.operators.delivery import dedup_tasks
from klaxon.operators.spikes import detect_spikes
from klaxon.plans import adapter as A
from klaxon.streaming import stateful

FOLDER = "/root/testdata/sf0.001"
HOUR = 3_600_000


def in_slices(df, order, path, slices=4):
    """Write df as `slices` files in time order; returns its schema."""
    rows = df.orderBy(order).toArrow()
    size = -(-rows.num_rows // slices)
    import pyarrow.parquet as pq

    os.makedirs(path)
    for i in range(slices):
        pq.write_table(rows.slice(i * size, size), f"{path}/{i:03d}.parquet")
        os.utime(f"{path}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return df.schema


def run(spark, transform, schema, source, sink, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(300)
    return query, spark.read.parquet(sink)


@pytest.fixture(scope="module")
def alerts(spark):
    return A.alerts(spark, FOLDER).cache()


def test_debounce_stream_equals_batch(spark, alerts, tmp_path):
    schema = in_slices(alerts, "event_timestamp", str(tmp_path / "in"))
    for ttl in (HOUR, 12 * HOUR):
        _, got = run(
            spark,
            lambda s: stateful.debounce_stream(s, ttl),
            schema,
            str(tmp_path / "in"),
            str(tmp_path / f"out{ttl}"),
            str(tmp_path / f"cp{ttl}"),
        )
        want = debounce(alerts, ttl)
        assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_spikes_stream_equals_batch(spark, alerts, tmp_path):
    schema = in_slices(alerts, "event_timestamp", str(tmp_path / "in"))
    config = (24 * HOUR, 3, 30 * HOUR)
    _, got = run(
        spark,
        lambda s: stateful.spikes_stream(s, *config),
        schema,
        str(tmp_path / "in"),
        str(tmp_path / "out"),
        str(tmp_path / "cp"),
    )
    want = detect_spikes(alerts, *config)
    pick = lambda d: sorted((r.region_id, r.event_count, r.triggering_event_ids[0]) for r in d.collect())
    assert pick(got) == pick(want)
    assert want.count() > 20


def test_dedup_stream_equals_batch(spark, alerts, tmp_path):
    tasks = alerts.limit(200).selectExpr(
        "event_id as task_id", "explode(array(0, 5, 15, 20)) as later", "event_timestamp"
    ).selectExpr("task_id", "event_timestamp + make_dt_interval(0, 0, later) as created_at").cache()
    schema = in_slices(tasks, "created_at", str(tmp_path / "in"))
    _, got = run(spark, stateful.dedup_stream, schema, str(tmp_path / "in"), str(tmp_path / "o"), str(tmp_path / "c"))
    pick = lambda d: sorted((r.task_id, r.created_at) for r in d.collect())
    assert pick(got) == pick(dedup_tasks(tasks))


def test_restart_keeps_locks_and_names_late_rows(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(
        rows, "event_id string, region_id string, event_type string, t string"
    ).selectExpr("event_id", "region_id", "event_type", "cast(t as timestamp) event_timestamp")
    first = make([("a", "R", "X", "2026-01-01 10:00:00"), ("b", "S", "X", "2026-01-01 10:00:00")])
    second = make([("c", "R", "X", "2026-01-01 10:30:00"), ("d", "R", "X", "2026-01-01 11:00:00")])
    third = make([("e", "R", "X", "2026-01-01 08:00:00"), ("f", "S", "X", "2026-01-01 11:30:00")])
    source = str(tmp_path / "in")
    for i, part in enumerate((first, second, third)):
        part.coalesce(1).write.mode("append").parquet(source)
        query, out = run(
            spark,
            lambda s: stateful.debounce_stream(s, keep_late=True),
            first.schema,
            source,
            str(tmp_path / "out"),
            str(tmp_path / "cp"),
        )
    assert sorted((r.event_id, r.late) for r in out.collect()) == [
        ("a", False),
        ("b", False),
        ("d", False),
        ("e", True),
        ("f", False),
    ]


def test_spikes_stream_counts_late_rows(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "event_id string, region_id string, t string").selectExpr(
        "event_id", "region_id", "cast(t as timestamp) event_timestamp"
    )
    source, dropped = str(tmp_path / "in"), 0
    parts = [
        make([("a", "R", "2026-01-01 10:00:00"), ("a", "R", "2026-01-01 10:00:00"), ("b", "R", "2026-01-01 10:01:00")]),
        make([("c", "R", "2026-01-01 10:02:00"), ("d", "R", "2026-01-01 10:03:00")]),
        make([("e", "R", "2026-01-01 09:00:00"), ("f", "R", "2026-01-01 10:13:30"), ("g", "R", "2026-01-01 10:13:40")]),
        make([("h", "R", "2026-01-01 10:13:50")]),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        query, out = run(
            spark, stateful.spikes_stream, parts[0].schema, source, str(tmp_path / "out"), str(tmp_path / "cp")
        )
        dropped += sum(stateful.rows_dropped_late(p) for p in query.recentProgress)
    fired = sorted((r.triggering_event_ids[0], r.event_count) for r in out.collect())
    assert fired == [("c", 3), ("h", 3)]
    assert dropped == 1
