"""Snapshot files with lines that can't be read, log offsets, and folds of the title statistics."""

import pytest
from pyspark.sql import functions as F

from klaxon.plans import adapter as A
from klaxon.schemas import UNRECOGNIZED_LOCATION
from klaxon.sources import feeds, logs
from klaxon.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_unreadable_lines(spark, tmp_path):
    lines = [
        '{"alerts":[{"id":1,"location_title":"a","new":2}],"disclaimer":"x","more":[1]}',
        '{"alerts":[{"id":2,',
        "",
        "  ",
        "nonsense",
        '{"alerts":null}',
        '{"alerts":[{"id":"no number"}]}',
    ]
    for i, part in enumerate((lines[:3], lines[3:])):
        (tmp_path / f"{i}.json").write_text("\n".join(part))
    read = feeds.read_snapshot_lines(spark, str(tmp_path))
    good, bad = feeds.split_unreadable(read)
    assert [r.id for r in feeds.explode_alerts(good).collect()] == [1]
    found = {(r.source_file.rsplit("/", 1)[1], r.text) for r in bad.collect()}
    assert found == {("0.json", lines[1]), ("1.json", lines[4]), ("1.json", lines[6])}
    assert feeds.read_snapshots(spark, str(tmp_path)).count() == 1


def test_offsets_follow_event_time_and_never_meet(spark):
    encoded = logs.encode_alerts(A.alerts(spark, FOLDER))
    when = F.get_json_object("value", "$.timestamp").alias("at")
    seen = set()
    for run, batch in ((0, 0), (0, 1), (1, 0)):
        rows = logs.as_log_records(encoded, "t", batch_id=batch, run=run).select("partition", "offset", "key", when).collect()
        again = logs.as_log_records(encoded.repartition(7), "t", batch_id=batch, run=run).select("partition", "offset", "key", when)
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
        places = {(r.partition, r.offset) for r in rows}
        assert len(places) == len(rows) and not places & seen
        seen |= places
        for r, later in zip(ordered := sorted(rows, key=lambda r: (r.key, r.offset)), ordered[1:]):
            assert r.key != later.key or r.at <= later.at
    # A null key and a body without a time get offsets too.
    odd = spark.createDataFrame([(None, "x"), ("k", None), ("k", '{"a":1}')], "key string, value string")
    assert logs.as_log_records(odd, "t", batch_id=0).filter("offset is not null").count() == 3


@pytest.fixture
def found(spark):
    def rows(*titles):
        at = F.lit("2026-10-01 10:00:00").cast("timestamp")
        df = spark.createDataFrame([(hash(t) % 1000, t, n) for t, n in titles], "id long, raw_title string, occurrences_count long")
        return df.withColumn("first_seen_at", at).withColumn("last_seen_at", at).select(*UNRECOGNIZED_LOCATION.names)

    return rows


def test_folds_count_once(spark, tmp_path, found):
    at = lambda n: str(tmp_path / n)
    totals = lambda: {r.raw_title: r.occurrences_count for r in jobs.read_totals(spark, at("totals")).collect()}
    assert jobs.fold_discovery(spark, at("found"), at("totals")) == 0 and totals() == {}
    jobs.overwrite_batch(found(("A", 2), ("a", 1)), at("found"), jobs.Batch("run", 0))
    jobs.overwrite_batch(found(("A", 3)), at("found"), jobs.Batch("run", 1))
    assert jobs.fold_discovery(spark, at("found"), at("totals")) == 2
    assert jobs.fold_discovery(spark, at("found"), at("totals")) == 2
    assert totals() == {"A": 5, "a": 1}
    # A replayed batch is no new commit; a new one is folded on top.
    jobs.overwrite_batch(found(("A", 3)), at("found"), jobs.Batch("run", 1))
    jobs.overwrite_batch(found(("B", 7)), at("found"), jobs.Batch("run", 2))
    jobs.overwrite_batch(found(), at("found"), jobs.Batch("run", 3))
    assert jobs.fold_discovery(spark, at("found"), at("totals")) == 4
    assert totals() == {"A": 5, "a": 1, "B": 7}
    # A fold that was lost before its commit is made again from the same place.
    jobs.overwrite_batch(found(("B", 1)), at("found"), jobs.Batch("run", 4))
    from klaxon.sources import commits

    real, commits.commit_batch = commits.commit_batch, lambda *a: None
    try:
        jobs.fold_discovery(spark, at("found"), at("totals"))
    finally:
        commits.commit_batch = real
    assert totals()["B"] == 7
    jobs.fold_discovery(spark, at("found"), at("totals"))
    assert totals() == {"A": 5, "a": 1, "B": 8}
