"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (A-Z folded), weighted by how often they occur.  For
each of SAMPLES independent samples every word has its own hash-drawn r, c (Gamma(2, 1)) and b
(uniform); a word of weight w is quantised to t = floor(ln w / r + b), and the word with the
least ln c - r (t - b) - r is drawn.  Two texts draw alike with the probability of their
generalised Jaccard similarity: sum of the lesser weights over sum of the greater.  A draw is
kept as 16 bits, so unlike draws agree by chance once in 65,536.

The edited text of a row needs the row after it in the order of ids.  Rows are dealt to ranges
of ids, each range also gets the first row of the next one, and is sorted by Spark; so each
text moves once and no task holds more than a slice of its range.

Nulls: a null text is empty; an empty text has no words, and is like other texts without words
only.  Null ids come before all others; rows of one id are ordered by text.  One row is its own
next.  Repeated rows are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from klaxon.llm.common import bytes_of, map_batches, shuffle_partitions
from klaxon.llm.exact_dedup import search
from klaxon.llm.words import U, hashes, mix, spans

SAMPLES = 128
SLICE_CHARS = 3 << 20


def word_weights(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, distinct words per text) of whole texts."""
    ends, body = bytes_of(pa.array(texts, pa.large_string()))
    starts, stops, per_row = spans(ends, body)
    words = hashes(body, starts, stops)
    row = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(words)))
    return words[first], counts.astype(np.float64), np.bincount(row[first], minlength=len(texts))


def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers above 0 from each 64-bit hash."""
    scale = 2.0**-32
    return ((h >> U(32)).astype(np.float64) + 0.5) * scale, ((h & U(0xFFFFFFFF)).astype(np.float64) + 0.5) * scale


def samples(words: np.ndarray, weights: np.ndarray, per_row: np.ndarray, k: int = SAMPLES) -> np.ndarray:
    """Draws of each weighted set as 16-bit numbers, one row each; 0 in all for an empty set."""
    out = np.zeros((len(per_row), k), np.uint16)
    if not len(words):
        return out
    # Each (word, weight) is worked out once for all the sets that hold it.
    pair = mix(words ^ mix(weights.view(U)))
    _, first, place = np.unique(pair, return_index=True, return_inverse=True)
    base, log_weight = words[first], np.log(weights[first])
    filled = np.flatnonzero(per_row)
    starts = (np.cumsum(per_row) - per_row)[filled]
    for d in range(k):
        h = mix(base + U(d + 1) * U(0x9E3779B97F4A7C15))
        u, v = halves(h)
        r = -np.log(u * v)
        h = mix(h)
        u, v = halves(h)
        c = -np.log(u * v)
        b, _ = halves(mix(h))
        t = np.floor(log_weight / r + b)
        rank = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(rank[place], starts)
        out[filled, d] = (mix(least.view(U)) >> U(48)).astype(np.uint16)
    return out


def fingerprint(row: np.ndarray) -> str:
    return base64.b64encode(row.astype("<u2").tobytes()).decode()


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_bucket, _ahead, _id, _text: ranges of ids, each with the first row of the next (_ahead)."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    parts = shuffle_partitions(df.sparkSession)
    cuts = rows.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(x) for x in cuts})
    placed = rows.withColumn("_bucket", F.coalesce(search(F.col("_id"), cuts, "bigint"), F.lit(0)))
    # One row per bucket comes back.
    heads = placed.groupBy("_bucket").agg(F.min("_id").alias("_low"), F.max(F.col("_id").isNull()).alias("_nulls"))
    found = [(r["_bucket"], None if r["_nulls"] else r["_low"]) for r in heads.orderBy("_bucket").collect()]
    before = [(b, low, found[i - 1][0]) for i, (b, low) in enumerate(found)]
    ahead = df.sparkSession.createDataFrame(before, "_b int, _low bigint, _to int")
    match = (F.col("_bucket") == F.col("_b")) & F.col("_id").eqNullSafe(F.col("_low"))
    own = F.struct(F.col("_bucket"), F.lit(0).alias("_ahead"))
    lent = F.struct(F.col("_to").alias("_bucket"), F.lit(1).alias("_ahead"))
    goes = F.when(F.col("_b").isNull(), F.array(own)).otherwise(F.array(own, lent))
    dealt = placed.join(F.broadcast(ahead), match, "left").select("_id", "_text", F.explode(goes).alias("_g"))
    return (
        dealt.select("_g._bucket", "_g._ahead", "_id", "_text")
        .repartition("_bucket")
        .sortWithinPartitions("_bucket", "_ahead", "_id", "_text")
    )


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they are."""
    schema = (
        f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )

    def judged(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which is only what follows them."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
        marks = samples(*word_weights(texts + edited))
        n = len(edited)
        plain, made = marks[: n + 1], marks[n + 1 :]
        columns = [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(x) for x in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([fingerprint(x) for x in plain[:n]]),
            pa.array([fingerprint(x) for x in made]),
            pa.array((plain[:n] == made).mean(1)),
            pa.array((plain[:n] == plain[1:]).mean(1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *NAMES])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, bucket, closed = [], [], 0, None, True
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_bucket", "_ahead", "_id", "_text"))
            for where, ahead, doc, text in zip(*columns):
                if where != bucket:
                    ids, texts, size, bucket, closed = [], [], 0, where, False
                if closed:
                    continue  # further rows of the next range's first id
                text = text or ""
                ids.append(doc)
                texts.append(text)
                size += len(text)
                closed = ahead == 1
                if len(texts) > 1 and (closed or size > SLICE_CHARS):
                    yield judged(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return map_batches(with_next(df, id_col, text_col), work, schema)
