"""Streams in event-time order: the batch result for shuffled feeds, and every late row."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from klaxon.operators.debounce import debounce
from klaxon.operators.spikes import detect_spikes
from klaxon.plans import adapter as A
from klaxon.streaming import ordered
from tests.plain import gate

FOLDER = "/root/testdata/sf0.001"
HOUR = 3_600_000
DELAY = 6 * HOUR


def write_slices(rows, path, slices):
    """`rows` (an Arrow table) as files in the order of arrival."""
    os.makedirs(path)
    size = -(-rows.num_rows // slices)
    for i in range(slices):
        pq.write_table(rows.slice(i * size, size), f"{path}/{i:03d}.parquet")
        os.utime(f"{path}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def shuffled(df, seed, lateness_ms):
    """Rows in order of time plus a random lateness below the bound."""
    table = df.toArrow()
    at = table.column("event_timestamp").cast("int64").to_numpy() // 1000
    rng = random.Random(seed)
    arrival = sorted(range(len(at)), key=lambda i: at[i] + rng.randrange(lateness_ms))
    return table.take(arrival)


def drained(spark, transform, schema, source, tmp_path):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = transform(stream).writeStream.format("parquet").option("path", sink)
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return spark.read.parquet(sink)


@pytest.fixture(scope="module")
def alerts(spark):
    return A.alerts(spark, FOLDER).cache()


def with_end(spark, alerts):
    """A row long after all others, so that the watermark passes them."""
    end = alerts.orderBy(F.desc("event_timestamp")).limit(1)
    end = end.withColumn("event_timestamp", F.expr("event_timestamp + interval 30 days"))
    return end.withColumn("event_id", F.lit("end")).withColumn("region_id", F.lit("END"))


def arranged(spark, alerts, tmp_path, seed=3):
    import pyarrow as pa

    table = shuffled(alerts, seed, DELAY)
    whole = pa.concat_tables([table, with_end(spark, alerts).toArrow().cast(table.schema)])
    write_slices(whole, str(tmp_path / "in"), 5)
    return alerts.schema


def test_debounce_of_a_shuffled_feed(spark, alerts, tmp_path):
    schema = arranged(spark, alerts, tmp_path)
    got = drained(
        spark,
        lambda s: ordered.ordered_debounce_stream(s, 2 * HOUR, delay_ms=DELAY, slot_ms=HOUR),
        schema, str(tmp_path / "in"), tmp_path,
    ).filter("event_id <> 'end'")
    want = debounce(alerts, 2 * HOUR)
    assert got.filter("late or ended").count() == 0
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_debounce_with_markers(spark, alerts, tmp_path):
    schema = arranged(spark, alerts, tmp_path)
    ends = F.col("event_id").endswith("7")
    marks = lambda df: df.filter(ends).select("region_id", "event_type", "event_timestamp")
    got = drained(
        spark,
        lambda s: ordered.ordered_debounce_stream(s.filter(~ends), 240 * HOUR, marks(s), delay_ms=DELAY, slot_ms=HOUR),
        schema, str(tmp_path / "in"), tmp_path,
    ).filter("event_id <> 'end'")
    want = debounce(alerts.filter(~ends), 240 * HOUR, ended=marks(alerts))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())
    assert want.count() > debounce(alerts.filter(~ends), 240 * HOUR).count()


def test_spikes_of_a_shuffled_feed(spark, alerts, tmp_path):
    doubled = alerts.unionByName(alerts.limit(300))  # repeats of an id at one ms count once
    schema = arranged(spark, doubled, tmp_path)
    config = (24 * HOUR, 3, 30 * HOUR)
    found = drained(
        spark,
        lambda s: ordered.ordered_spikes_stream(s, *config, delay_ms=DELAY, slot_ms=HOUR),
        schema, str(tmp_path / "in"), tmp_path,
    )
    got, late = ordered.split_spikes(found, *config[:2])
    want = detect_spikes(alerts, *config)
    assert late.count() == 0
    rows = lambda d: sorted((r.anomaly_id, r.event_count) for r in d.collect())
    assert rows(got) == rows(want) and want.count()


def test_late_rows_come_out(spark, alerts, tmp_path):
    """Rows that come long after their time are all in the late output, the others as in a batch without them."""
    import pyarrow as pa

    ordered_rows = alerts.orderBy("event_timestamp").toArrow()
    old = ordered_rows.slice(0, 40)
    rest = ordered_rows.slice(40)
    write_slices(pa.concat_tables([rest, with_end(spark, alerts).toArrow().cast(rest.schema), old]), str(tmp_path / "in"), 6)
    config = (24 * HOUR, 3, 30 * HOUR)
    found = drained(
        spark,
        lambda s: ordered.ordered_spikes_stream(s, *config, delay_ms=HOUR, slot_ms=HOUR),
        alerts.schema, str(tmp_path / "in"), tmp_path,
    )
    got, late = ordered.split_spikes(found, *config[:2])
    late_ids = {r.event_id for r in late.collect()}
    assert late_ids and late_ids <= set(old.column("event_id").to_pylist())
    on_time = alerts.filter(~F.col("event_id").isin(*late_ids))
    rows = lambda d: sorted((r.anomaly_id, r.event_count) for r in d.collect())
    assert rows(got) == rows(detect_spikes(on_time, *config))


def test_passing_equals_loop():
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        ms = sorted(rng.sample(range(200), rng.randrange(40)))
        marks = sorted(rng.sample(range(200), rng.randrange(6)))
        hold = rng.randrange(1, 50)
        cut = rng.randrange(200)
        want = [t for _, t, _ in gate([("k", t, "") for t in ms], hold, True, [("k", m) for m in marks])]
        got, last, free = [], None, 0
        for low, high in ((0, cut), (cut, 200)):
            part = np.array([t for t in ms if low <= t < high], np.int64)
            own = np.array([m for m in marks if low <= m < high], np.int64)
            found, last, free = ordered.passing(part, own, hold, last, free)
            got += part[found].tolist()
        assert got == want
