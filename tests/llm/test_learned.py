"""The learned operators: plain versions of what they compute, what they learn, and the bounds of their samples."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from klaxon.llm import labelled, langid, quality, toxicity
from klaxon.llm.common import fold, table

FOLDER = "/root/testdata/sf0.01"


def noise(rng, n):
    return ["".join(rng.choices(["th", "an", "er", "on", "st"], k=rng.randint(1, 4))) for _ in range(n)]


def area(scores, labels):
    """Share of (toxic, clean) pairs in the right order, ties half."""
    bad, good = scores[labels == 1], np.sort(scores[labels == 0])
    below, upto = np.searchsorted(good, bad, "left"), np.searchsorted(good, bad, "right")
    return float((below + upto).sum()) / 2 / (len(bad) * len(good))


# -- toxicity --------------------------------------------------------------------------------


def test_word_order_alone_decides():
    rng, texts = random.Random(1), []
    for i in range(1200):
        words = noise(rng, rng.randint(10, 60))
        at = rng.randrange(len(words) - 1)
        words[at : at + 2] = ["bad", "cat"] if i % 2 else ["cat", "bad"]
        texts.append(" ".join(words))
    labels = np.arange(1200) % 2
    net = toxicity.fit(texts[:900], labels[:900])
    assert ((net.scores(pa.array(texts[900:])) >= 0.5) == labels[900:]).mean() > 0.9


def test_held_out_texts_are_ranked(spark):
    """A list of the words' label log-odds gets 0.93 here."""
    folder = "/root/testdata/sf0.1"
    known = table(spark, folder, "labels").select("doc_id", "toxic")
    found = toxicity.classify(table(spark, folder, "documents"), known, fold() != 0).filter(fold() == 0)
    rows = found.join(known, "doc_id").filter("toxic is not null").select("score", "toxic").toPandas()
    assert area(rows["score"].to_numpy(), rows["toxic"].to_numpy()) > 0.94


def test_network_equals_plain_loops():
    net = toxicity.Network(5)
    texts = ["one two  THREE, four", "x", "", None, " ".join(f"w{i % 7}" for i in range(70))]
    words = toxicity.Words(pa.array(texts))
    x, p = net.inputs(words).astype(float), {k: v.astype(float) for k, v in net.p.items()}
    h = toxicity.HIDDEN

    def squash(v):
        return 1 / (1 + np.exp(-v))

    def states(inputs, side):
        state, out = np.zeros(h), []
        for v in inputs:
            gate, own = v @ p["W" + side] + p["b" + side], state @ p["U" + side]
            r, z = squash(gate[:h] + own[:h]), squash(gate[h : 2 * h] + own[h : 2 * h])
            state = (1 - z) * np.tanh(gate[2 * h :] + r * own[2 * h :]) + z * state
            out.append(state)
        return out

    def logit(inputs):
        both = [np.concatenate(s) for s in zip(states(inputs, "f"), states(inputs[::-1], "b")[::-1])]
        weight = [math.exp(np.tanh(s @ p["A"]) @ p["v"]) for s in both]
        return sum(w * s for w, s in zip(weight, both)) @ p["u"] / sum(weight) + p["c"][0]

    start, expected = 0, []
    for n in words.per_row.tolist():
        own, best = [x[k] for k in words.sequence[start : start + n]], -np.inf
        for at in range(0, max(1, n - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            if own[at:]:
                best = max(best, logit(own[at : at + toxicity.WINDOW]))
        expected.append(squash(best))
        start += n
    assert net.scores(pa.array(texts)) == pytest.approx(expected, abs=1e-5)


def test_parting():
    scores, labels = np.array([0.0, 1, 2, 5, 6, 7]), np.array([0, 0, 0, 1, 1, 1])
    assert toxicity.parting(scores, labels) == 3.5
    assert toxicity.parting(scores, 1 - labels) in (-np.inf, 0.5, 6.5)
    assert toxicity.parting(scores, np.ones(6, int)) == -np.inf
    assert toxicity.parting(np.zeros(6), labels) == -np.inf


# -- samples ---------------------------------------------------------------------------------


def test_only_usable_documents_take_a_place(spark):
    """Labels without a document, of long or of null texts, don't use up the bound; an id is one row."""
    docs = [(i, f"text {i}") for i in range(40)] + [(i, "x" * 200) for i in range(40, 90)]
    docs += [(i, None) for i in range(90, 99)] + [(7, "another")] * 50
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = labelled.labelled_sample(frame, labels, "toxic", F.lit(True), {1: 10, 0: 15}, 100).collect()
    assert collections.Counter(r["_label"] for r in got) == {1: 10, 0: 15}
    assert len({r["_id"] for r in got}) == 25 and all(r["_id"] < 40 for r in got)
    every = labelled.labelled_sample(frame, labels, "toxic", F.lit(True), {None: 1000}, 100).collect()
    assert sorted(r["_id"] for r in every) == list(range(40))


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rows = [(None, f"text {i}", "hot") for i in range(500)] + [(5, "same", "hot")] * 300
    rows += [(i, f"text {i}", "big") for i in range(3000)] + [(i, f"t {i}", f"l{i % 40}") for i in range(80)]
    known = spark.createDataFrame(rows, "_id long, text string, lang string")
    got = collections.Counter(r["lang"] for r in langid.sampled(known).collect())
    assert sum(got.values()) <= 60 and len(got) == 42 and set(got.values()) == {1}
    few = langid.sampled(known.filter("lang IN ('hot', 'big')")).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in few} == {"hot": 30, "big": 30}
    monkeypatch.setattr(langid, "SAMPLE", 20)
    assert langid.sampled(known).count() <= 20


# -- language and quality --------------------------------------------------------------------


def test_language_scores_equal_dictionaries():
    """n-gram vectors as dictionaries, where hashing is the only thing taken over."""
    rng = np.random.default_rng(3)
    idf, centroids = rng.random(langid.DIMS).astype(np.float32), rng.random((5, langid.DIMS)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    model = langid.Model(idf, centroids, ["a", "a", "b", "c", "c"], np.zeros(5))
    texts = ["The cat  sat!", "Žluťoučký kůň", "x", "12", None, "a b c d " * 300]

    def plain(text):
        body = [b if b in range(0x61, 0x7B) or b >= 0x80 else 0x20 for b in text.lower().encode()]
        found = collections.Counter()
        for width in (1, 2, 3):
            for i in range(len(body) - width + 1):
                gram = body[i : i + width]
                if gram == [0x20] or any(a == b == 0x20 for a, b in zip(gram, gram[1:])):
                    continue
                number = int.from_bytes(bytes(gram), "big") * 2654435761 + width * 0x12F0B5AB
                found[(number % 2**32) >> (32 - langid.DIM_BITS)] += 1
        x = {k: math.log1p(n) * float(idf[k]) for k, n in found.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return [sum(v / size * float(c[k]) for k, v in x.items()) for c in centroids]

    names, near, _ = model.judge(pa.array(texts))
    for text, name, score in zip(texts, names, near.tolist()):
        if text is None or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
        else:
            similar = plain(text)
            assert score == pytest.approx(max(similar), abs=1e-4)
            assert name == model.languages[similar.index(max(similar))]


def test_quality_scores_equal_dictionaries(spark):
    rng = np.random.default_rng(4)
    weights = rng.standard_normal((1 << quality.SLOT_BITS) + 1).astype(np.float32)
    texts = ["one two two, three!", "x", "", None, "a b " * 20_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    for i, text in enumerate(texts):
        found, _ = quality.slots(pa.array([text or ""]))
        total = sum(n * float(weights[k]) for k, n in collections.Counter(found.tolist()).items())
        total = total / math.sqrt(max(1, len(found))) + float(weights[-1])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_held_out_languages_and_quality(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    own = langid.identify(docs, use=fold() != 0).filter(fold() == 0).filter("lang is not null")
    right = own.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    scored = quality.classify(docs, labels, fold() != 0).filter(fold() == 0)
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").filter("quality is not null").toPandas()
    assert right > 0.95 and area(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95


# -- pipeline --------------------------------------------------------------------------------


def test_pipeline_keeps_clashing_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").withColumn("_toxicity", F.lit("own"))
    docs = docs.withColumn("_judged_rejected", F.lit(True)).withColumn("_class", F.lit(3)).withColumn("Score", F.lit("s"))
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert kept.select("_toxicity", "_judged_rejected", "_class", "Score").distinct().collect() == [("own", True, 3, "s")]
        assert stage(spark, docs.limit(0), folder).count() == 0
