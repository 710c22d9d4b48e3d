"""Committed batches: a replay between two readers, attempts without a commit, folder columns."""

import json
import os

from klaxon.sources import commits
from klaxon.streaming import jobs

SCHEMA = "id long, channel string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, "a b" if i % 2 else None) for i in ids], SCHEMA)


def drain(spark, path, sink, checkpoint):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = commits.read_committed(spark, path, schema)
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return sorted((r["id"], r["channel"]) for r in spark.read.schema(SCHEMA).parquet(sink).collect())


def test_replay_between_two_readers(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    jobs.overwrite_batch(rows(spark, 1, 2), at("t"), jobs.Batch("run", 0), "channel")
    assert drain(spark, at("t"), at("out"), at("cp")) == [(1, "a b"), (2, None)]

    # An attempt that was lost before its commit is not read; its replay replaces it.
    real, commits.commit_batch = commits.commit_batch, lambda *a: None
    try:
        jobs.overwrite_batch(rows(spark, 3), at("t"), jobs.Batch("run", 1), "channel")
    finally:
        commits.commit_batch = real
    assert len(drain(spark, at("t"), at("out"), at("cp"))) == 2
    jobs.overwrite_batch(rows(spark, 3, 4), at("t"), jobs.Batch("run", 1), "channel")
    assert [i for i, _ in drain(spark, at("t"), at("out"), at("cp"))] == [1, 2, 3, 4]

    # Committed batches again: nothing is written, nothing is read twice, here or by a new reader.
    for number, ids in ((0, (1, 2)), (1, (3, 4))):
        jobs.overwrite_batch(rows(spark, *ids), at("t"), jobs.Batch("run", number), "channel")
    assert [i for i, _ in drain(spark, at("t"), at("out"), at("cp"))] == [1, 2, 3, 4]
    assert [i for i, _ in drain(spark, at("t"), at("out2"), at("cp2"))] == [1, 2, 3, 4]

    # Another run adds; an empty batch is a commit without files.
    jobs.overwrite_batch(rows(spark, 9), at("t"), jobs.Batch("other", 0), "channel")
    jobs.overwrite_batch(rows(spark), at("t"), jobs.Batch("other", 1), "channel")
    assert [i for i, _ in drain(spark, at("t"), at("out"), at("cp"))] == [1, 2, 3, 4, 9]
    assert commits.commit_numbers(at("t")) == [0, 1, 2, 3]
    assert commits.read_commit(at("t"), 3)["files"] == []


def test_run_is_the_query_not_the_path(spark, tmp_path):
    for cp in ("a", "b"):
        os.makedirs(tmp_path / cp)
        (tmp_path / cp / "metadata").write_text(json.dumps({"id": f"query-{cp}"}))
    assert jobs.run_of(spark, str(tmp_path / "a")) == jobs.run_of(spark, f"file://{tmp_path}/a/") == "query-a"
    assert jobs.run_of(spark, str(tmp_path / "b")) == "query-b"
