"""Text quality: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters and digits or runs of other signs, A-Z folded.  Single words and
pairs are hashed to 2^20 slots (a word and its repeat share one); a text's vector has each n-gram's count over the square root
of the number of n-grams.  Weights come from a bounded sample of labelled rows (SAMPLE, texts of at
most FIT_CHARS); every text, however long, is scored whole as one sparse dot product.

Nulls and empty texts have no n-gram, their score is that of the bias.  Labels that are null, or
have no document that may be learned from, are not used; of several labels of an id the largest
is, of several texts the least by hash.  Without any label every score is 0.5, and an empty table
gives an empty result.  Repeated rows are scored each.  An input column named as the score is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klaxon.llm.common import appended, bytes_of, map_batches, slices, with_columns
from klaxon.llm.labelled import labelled_sample
from klaxon.llm.words import MARKED, U, hashes, mix, row_sums, shingles, spans

SLOT_BITS = 20
# A word followed by itself is one and the same pair, whatever the word.
REPEAT = U(0x9E3779B97F4A7C15)
# Labelled rows that are learned from at most, and the longest text of them.
SAMPLE, FIT_CHARS = 8192, 30_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 1.0


def slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, number per row) of the words and word pairs of each text."""
    ends, body = bytes_of(column)
    starts, stops, per_row = spans(ends, body, MARKED)
    words = hashes(body, starts, stops)
    pairs = np.where(words[:-1] == words[1:], REPEAT, mix(words[:-1] * U(3) + words[1:]))
    rows = np.repeat(np.arange(len(per_row)), per_row)
    same = rows[1:] == rows[:-1]
    order = np.concatenate([rows, rows[1:][same]])
    found = np.concatenate([words, pairs[same]]) >> U(64 - SLOT_BITS)
    by_row = np.argsort(order, kind="stable")
    return found[by_row].astype(np.int32), np.bincount(order, minlength=len(per_row))


class Ftrl:
    """FTRL-proximal logistic regression with one bias slot beyond the hashed ones."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        kept = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -kept / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        squares = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += squares


def sparse(found: np.ndarray, bias: int) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(found, return_counts=True)
    return np.append(at, bias), np.append(count / max(1, len(found)) ** 0.5, 1.0)


def fit(sample: DataFrame) -> np.ndarray:
    """Weights by slot, the bias last, from _id, _label, _text (a bounded sample), learned in one task."""

    def work(group: pa.Table) -> pa.Table:
        found, per_row = slots(group.column("_text").combine_chunks())
        parts = np.split(found, np.cumsum(per_row)[:-1])
        rows = zip(group.column("_id").to_pylist(), group.column("_label").to_pylist(), parts)
        known = sorted(rows, key=lambda r: r[0] * 0x9E3779B97F4A7C15 % 2**64)
        model = Ftrl(1 << SLOT_BITS)
        for _ in range(EPOCHS):
            for _, label, found in known:
                at, x = sparse(found, 1 << SLOT_BITS)
                model.learn(at, x, label)
        return pa.table({"weights": pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())})

    rows = sample.select(F.col("_id").cast("long"), F.col("_label").cast("long"), "_text", F.lit(0).alias("_all"))
    learned = rows.groupBy("_all").applyInArrow(work, "weights binary").collect()
    if not learned:
        return np.zeros((1 << SLOT_BITS) + 1, np.float32)
    return np.frombuffer(learned[0]["weights"], np.float32)


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", into: str = "score") -> DataFrame:
    """`df` with the probability of label 1."""
    schema = appended(df, [T.StructField(into, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found, per_row = slots(batch.column(text_col))
            sums = row_sums(weights[found], per_row) / np.sqrt(np.maximum(1, per_row)) + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield with_columns(batch, schema.names, {into: pa.array(p)})

    return map_batches(df, work, schema)


def classify(
    df: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", id_col: str = "doc_id"
) -> DataFrame:
    """Fit on the rows that `use` allows, then `df` with score."""
    return score(df, fit(labelled_sample(df, labels, label_col, use, {None: SAMPLE}, FIT_CHARS, id_col)))
