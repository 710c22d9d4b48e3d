"""The pipeline on the smallest tables: each stage against plain rules on what it was given."""

import collections

import corpus_pipeline as pipeline
from klaxon.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, docs.collect()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, FOLDER), f"test-{name}")
        after = docs.collect()
        assert docs.columns == columns
        assert not collections.Counter(after) - collections.Counter(before)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
            assert {r["doc_id"] for r in after} == set(best.values())
        else:
            assert len(after) >= 0.8 * len(before)
        before = after
    packed = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in before}


def test_run(spark):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "near_dedup", "packing"]
    assert pipeline.run(spark, FOLDER).count() > 0
