"""Phrase mining against plain counting in Python."""

import collections
import random
import re

import pytest

from klaxon.llm import phrases

SCHEMA = "lang string, text string, n int, gram string, `group` string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    return counts, totals


def plain(rows, least, best):
    counts, totals = counted(rows)
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, a in found.items():
            for k in range(2, len(q)):
                inside |= {q[i : i + k] for i in range(len(q) - k + 1) if 100 * a >= 100 * c[q[i : i + k]]}
        ranked = []
        for p in found.keys() - inside:
            score, k = min((1000 * c[p] * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:best]):
            yield lang, i + 1, p.decode(), -a, left, right, totals[lang], -score


def check(spark, rows, least, best):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collections.Counter(map(tuple, phrases.mine_phrases(df, least=least, best=best).collect()))
    assert got == collections.Counter(plain(rows, least, best))
    return got


def padded(rows):
    return [(*r, 1, "clash", "clash") for r in rows]


ODD = [
    ("x", "A b\tc  d e f. a b c d e\x0bf g"), ("x", None), (None, ""), (None, "é   é"), ("y", "a"), ("y", " . ,"),
    ("x", "a b c d e f g h"), ("x", "é"), ("x", "é"), ("x", "z"), ("und", "é é"),
]
CASES = {
    "empty": [],
    "no words": [("x", "")],
    "odd": ODD * 3,
    "one word": [("x", "a b")] * 3 + [("x", " ".join(["a"] * 5000))],
    "long": [("x", "one two three four five six seven. " * 60_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    check(spark, padded(CASES[name]), 2, 10)


def test_prose(spark):
    rng = random.Random(8)
    words = ["the", "and", "of", "thing", "für", "nicht", "rare" * 9, "W"]
    passage = "a passage that many texts share, with a comma in it and more words behind"
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, [9, 5, 4, 2, 2, 1, 1, 1], k=80))) for _ in range(60)]
    rows += [(g, f"{t} {passage}") for g, t in rows[:30]]
    assert check(spark, padded(rows), 12, 30)


def test_registered(spark):
    from klaxon.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op12_phrases"](spark, folder).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(docs, 100, 2000))
