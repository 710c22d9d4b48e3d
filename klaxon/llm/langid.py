"""Language identification: nearest of several TF-IDF n-gram centroids per language.

Texts are lower-cased, all but letters become spaces, and n-grams of one to three bytes are
hashed to DIMS numbers.  Document frequencies cover every text that may be learned from; the
centroids are clusters (spherical k-means) of a bounded sample of each language.  A text gets
the language of the centroid nearest by cosine; it is rejected where it is less similar to it
than REJECT times a low quantile of that centroid's own sampled texts.

Nulls, empty texts and texts without a letter are `und` with score 0, and rejected.  A null
language is not learned from; without any language all texts are `und`, and an empty table gives
an empty result.  Of equally near centroids the first language by name is taken.  Very long texts
are judged whole, repeated rows each.  Input columns named as the results are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from klaxon.llm.common import appended, bytes_of, map_batches, slices, with_columns

DIM_BITS = 12
DIMS = 1 << DIM_BITS
# Sampled texts in all, and per language, at most; clusters of a language; rounds of k-means.
SAMPLE, SAMPLE_PER_LANGUAGE = 6000, 1000
CLUSTERS, ROUNDS = 4, 8
# A centroid's floor: this share of the similarity that QUANTILE of its own sampled texts fall below;
# with fewer than OWN texts, of that of all its language's.
REJECT, QUANTILE, OWN = 0.65, 0.01, 20
SLICE = 1 << 20
UND = "und"

LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def counts(column: pa.Array) -> np.ndarray:
    """n-gram counts, one row of DIMS per text."""
    ends, body = bytes_of(pc.utf8_lower(column.fill_null("")))
    rows, n = len(ends) - 1, len(body)
    found = np.zeros(rows * DIMS, np.float32)
    if not n:
        return found.reshape(rows, DIMS)
    letters = LETTERS[body].astype(np.uint32)
    base = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(ends))
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    blank = letters == 0x20
    gram = letters
    usable = ~blank
    total = np.zeros(rows * DIMS)
    for width in (1, 2, 3):
        if width > 1:
            if n < width:
                break
            m = n - width + 1
            gram = (gram[:m] << np.uint32(8)) | letters[width - 1 :]
            # No two spaces in a row, and no end of the text inside.
            usable = ~(blank[: m] & blank[1 : m + 1]) & (left[:m] >= width)
            if width == 3:
                usable &= ~(blank[1 : m + 1] & blank[2 : m + 2])
        slot = (gram * np.uint32(2654435761) + np.uint32(width * 0x12F0B5AB)) >> np.uint32(32 - DIM_BITS)
        key = (base[: len(slot)] + slot)[usable[: len(slot)]]
        total += np.bincount(key, minlength=rows * DIMS)
    return total.reshape(rows, DIMS)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a text without n-grams stays zero."""
    x = np.log1p(found.astype(np.float32)) * idf
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(size, 1e-12)[:, None]


def document_frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and of how many; DIMS + 1 sums come back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)
        for batch in slices(batches, "text", SLICE):
            found = counts(batch.column("text"))
            seen[:DIMS] += (found > 0).sum(0)
            seen[DIMS] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(seen)], names=["slot", "n"])

    summed = map_batches(df, work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    seen = np.zeros(DIMS + 1, np.int64)
    for row in summed.collect():
        seen[row["slot"]] = row["n"]
    return seen[:DIMS], int(seen[DIMS])


def clustered(x: np.ndarray) -> np.ndarray:
    """Unit centroids by spherical k-means, started from texts far from one another."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(CLUSTERS, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centroids = x[chosen].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                mean = x[own == k].sum(0)
                centroids[k] = mean / max(1e-12, float(np.sqrt(mean @ mean)))
    return centroids


def floors(x: np.ndarray, centroids: np.ndarray) -> list[float]:
    """The least similarity of each centroid that is not rejected."""
    similar = x @ centroids.T
    own, near = np.argmax(similar, axis=1), similar.max(1)
    groups = [near[own == k] for k in range(len(centroids))]
    return [REJECT * float(np.quantile(g if len(g) >= OWN else near, QUANTILE)) for g in groups]


class Model:
    """Inverse document frequencies, centroids, the language of each and its least similarity."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], least: np.ndarray):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, similarity, rejected) of each text."""
        has_letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.languages:
            has_letter[:] = False
        names, near = [UND] * len(column), np.zeros(len(column))
        far = np.ones(len(column), bool)
        if has_letter.any():
            similar = vectors(counts(column), self.idf) @ self.centroids.T
            best = np.argmax(similar, axis=1)
            top = similar[np.arange(len(best)), best].astype(float)
            names = [self.languages[k] if ok else UND for k, ok in zip(best.tolist(), has_letter.tolist())]
            near = np.where(has_letter, np.clip(top, 0, 1), 0.0)
            far = ~has_letter | (top < self.least[best])
        return names, near, far


def sampled(known: DataFrame) -> DataFrame:
    """lang, text of at most SAMPLE rows: the smallest ids by hash of each language.

    Rows by language and 1/4096 of the hashes are counted first; from these counts each language gets
    the least bound that leaves enough rows to be ranked.  Rows of one id (or of none) share a hash;
    tasks keep no more of them than are wanted.  Of more than SAMPLE languages the most frequent are
    sampled.
    """
    part = F.shiftright(F.xxhash64("_id"), 52)
    parts = known.groupBy("lang", part.alias("_part")).agg(F.count("*").alias("_rows"))
    kept = parts.groupBy("lang").agg(F.sum("_rows").alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(SAMPLE)
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // max(1, kept.count())))
    # At most 4096 rows a language.
    smaller = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        parts.withColumn("_before", F.coalesce(F.sum("_rows").over(smaller), F.lit(0)))
        .filter(F.col("_before") < each)
        .groupBy("lang")
        .agg(F.max("_part").alias("_bound"))
        .join(kept.select("lang"), "lang")
    )
    # At most SAMPLE rows.
    near = known.join(F.broadcast(bounds), "lang").filter(part <= F.col("_bound"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("text"))
    return near.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= each).select("lang", "text")


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the rows of `df` whose language is known."""
    known = df.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("_id")
    )
    seen, texts = document_frequencies(known.select("text"))
    idf = np.log((1 + texts) / (1 + seen)).astype(np.float32) + np.float32(1)
    sample = sampled(known)

    def work(group: pa.Table) -> pa.Table:
        column = group.column("text").combine_chunks()
        # One text at a time: texts of a sample may be long.
        found = np.concatenate([counts(column.slice(i, 1)) for i in range(len(column))]).astype(np.uint32)
        x = vectors(found[sorted(range(len(found)), key=lambda i: found[i].tobytes())], idf)
        x = x[np.einsum("ij,ij->i", x, x) > 0]
        own = clustered(x) if len(x) else x
        return pa.table(
            {
                "lang": pa.array([group.column("lang")[0].as_py()] * len(own), pa.string()),
                "nth": pa.array(np.arange(len(own)), pa.int64()),
                "centroid": pa.array([c.astype(np.float32).tobytes() for c in own], pa.binary()),
                "least": pa.array(floors(x, own) if len(x) else [], pa.float64()),
            }
        )

    made = sample.groupBy("lang").applyInArrow(work, "lang string, nth long, centroid binary, least double").collect()
    # At most one centroid per sampled text.
    made.sort(key=lambda r: (r["lang"], r["nth"]))
    centroids = [np.frombuffer(r["centroid"], np.float32)[None] for r in made]
    return Model(
        idf,
        np.concatenate([np.zeros((0, DIMS), np.float32), *centroids]),
        [r["lang"] for r in made],
        np.array([r["least"] for r in made]),
    )


def identify(
    df: DataFrame,
    use: Column | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    prefix: str = "",
) -> DataFrame:
    """`df` with lang_pred, score and rejected (after `prefix`); learns from the rows that `use` allows."""
    model = fit(df if use is None else df.filter(use), text_col, lang_col, id_col)
    new = [
        T.StructField(prefix + "lang_pred", T.StringType()),
        T.StructField(prefix + "score", T.DoubleType()),
        T.StructField(prefix + "rejected", T.BooleanType()),
    ]
    schema = appended(df, new)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            names, near, far = model.judge(batch.column(text_col))
            made = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(near), "rejected": pa.array(far)}
            yield with_columns(batch, schema.names, {prefix + k: v for k, v in made.items()})

    return map_batches(df, work, schema)
