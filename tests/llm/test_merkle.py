"""The Merkle manifest against a plain tree in Python."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from klaxon.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree int, `index` string, _group int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, n_chars):
    values = (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, place):
    for row in levels[:-1]:
        other = place ^ 1
        yield (row[other] if other < len(row) else None), place & 1
        place >>= 1


def plain(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
    trees = {g: levels_of([leaf_of(r, r["n_chars"]) for r in rs]) for g, rs in groups.items()}
    names = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels_of([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*way(trees[g], i), *way(top, k)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            at = leaf_of(r, r["n_chars"] + 1 if tampered and r["n_chars"] is not None else r["n_chars"])
            for sibling, right in path:
                at = h(at) if sibling is None else h(sibling, at) if right else h(at, sibling)
            proof = h(*[s for s, _ in path if s])
            yield r["doc_id"], trees[g][0][i], trees[g][-1][0], top[-1][0], proof, at, at == top[-1][0]


def check(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = merkle.manifest(df, changed={"n_chars": F.col("n_chars") + 1}, changes=tampered)
    got = collections.Counter(map(tuple, made.collect()))
    assert got == collections.Counter(plain([r.asDict() for r in df.collect()]))
    return got


ROW = (1, "a text", "x", None, 6, 1, "1", 1)
CASES = {
    "empty": [],
    "one": [ROW],
    "repeated": [ROW] * 5,
    "nulls": [(None,) * 8] * 3 + [(5, "", "x", "", 0, 1, "", 1), (7, "é", "y", "s", None, 1, "", 1), (None, "q", "x", "s", 3, 1, "", 1)],
    "long": [(i, "a long text " * 400_000, "x", "s", 1, 1, "", 1) for i in range(2)] + [ROW],
    "many groups": [(i, str(i), "en" if i % 50 else f"l{i}", "s", i, 0, "", 0) for i in range(1200)],
    "one id": [(4, str(i), "en", "s", i, 0, "", 0) for i in range(700)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    got = check(spark.createDataFrame(CASES[name], SCHEMA).repartition(3))
    assert sum(got.values()) == len(CASES[name])


def test_every_size(spark):
    # All shapes of a tree around a band's edge, as groups of one table.
    sizes = [1, 2, 3, 4, 5, 255, 256, 257, 513]
    rows = [(i, f"{n}-{i}", f"g{n:04}", "s", 0, 0, "", 0) for n in sizes for i in range(n)]
    got = check(spark.createDataFrame(rows, SCHEMA))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_registered(spark):
    from klaxon.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, folder)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain(docs))
