"""Collocations: phrases of up to five words that stand together more often than their parts suggest.

Texts (A-Z folded, others as they are) are cut at `[.,;:!?` and line ends`]` into pieces, pieces at
blanks and tabs into words.  All counts are per group (a language; null counts as `und`).

The counts come from a weighted de Bruijn graph.  Its nodes are phrases of LONGEST - 1 words, its
edges phrases of LONGEST words, each with the number of its occurrences:

1. Words are counted.  A phrase is at most as frequent as each of its words and pairs, so a word or
   a pair below the least count can't be in a candidate: pieces are cut there too.  Which words and
   pairs remain is known from two bit maps of fixed size, filled by hash; a word or pair that shares
   its bit with a frequent one is kept, which costs time and changes no count.
2. The longest phrases of the pieces are aggregated to edges, and the ends of the pieces, which no
   edge leaves, to corrections.
3. The count of a shorter phrase is its node's flow: the edges that leave it and the piece ends that
   stop at it.  Each order's nodes are the next shorter order's edges, so one shuffle a length does.
4. A node whose whole flow goes through one edge lies on an unary path: it is merged into that edge.
   What is merged is just what a longer phrase of the same count contains, so it is no candidate.

Scores are whole numbers of up to 38 digits before they are divided, so nothing is rounded.

Nulls: a null text is empty.  Ties in rank go to the higher count, then to the phrase in byte order,
so ranks are unique.  Repeated rows count each.  An empty table gives an empty result.  Texts of any
length are read whole; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from klaxon.llm.common import bytes_of, slices, stored

LONGEST = 5
LEAST = 100
BEST = 2000
# Bits of the two maps; their size does not depend on the input.
WORD_BITS = 23
PAIR_BITS = 23
# Top lists are made in so many shares of a group first.
SHARES = 64
SLICE = 6 << 20
# Where (groups x distinct words) of a slice is no more, they are counted in one array.
DENSE = 1 << 23

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
MASK = (1 << 64) - 1


class Words:
    """The words of a batch: `codes` into `terms`, the (group, word) pairs met; `piece` numbers their pieces."""

    def __init__(self, batch: pa.RecordBatch, group: str, text: str):
        ends, body = bytes_of(batch.column(text))
        upper = (body >= 65) & (body <= 90)
        body = body + upper.astype(np.uint8) * np.uint8(32)
        stop = ENDS[body]
        inside = ~(stop | BLANKS[body])
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = ends[1:-1]
        inner = edges[(edges > 0) & (edges < len(body))]
        first[inner] = inside[inner]
        last[inner - 1] = inside[inner - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.many = len(starts)
        row = np.searchsorted(ends, starts, "right") - 1
        self.piece = np.cumsum(stop)[starts] + row if self.many else np.zeros(0, np.int64)
        groups = batch.column(group).dictionary_encode()
        self.groups = groups.dictionary.to_pylist()
        # Words and the gaps between them, alternately, as one zero-copy array.
        bounds = np.empty(2 * self.many, np.int64)
        bounds[0::2], bounds[1::2] = starts, stops
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), max(0, 2 * self.many - 1), [None, pa.py_buffer(bounds), pa.py_buffer(body)]
        )
        coded = parts.take(pa.array(np.arange(0, 2 * self.many, 2))).dictionary_encode() if self.many else None
        self.words = coded.dictionary if self.many else pa.array([], pa.large_binary())
        size = max(1, len(self.words))
        word = coded.indices.to_numpy().astype(np.int64) if self.many else np.zeros(0, np.int64)
        key = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + word
        if len(self.groups) * size <= DENSE:
            counts = np.bincount(key, minlength=len(self.groups) * size)
            met = np.flatnonzero(counts)
            self.counts = counts[met]
            place = np.zeros(len(counts), np.int64)
            place[met] = np.arange(len(met))
            self.codes = place[key]
        else:
            met, self.codes, self.counts = np.unique(key, return_inverse=True, return_counts=True)
        self.term_group, self.term_word = np.divmod(met, size)

    def hashes(self) -> np.ndarray:
        """Of each (group, word) pair, as Spark's xxhash64 makes them."""
        seeds = [xxhash.xxh64_intdigest((g or "").encode(), 42) for g in self.groups]
        words = self.words.to_pylist()
        digest = xxhash.xxh64_intdigest
        found = (digest(words[w], seeds[g]) for g, w in zip(self.term_group.tolist(), self.term_word.tolist()))
        return np.fromiter(found, np.uint64, len(self.term_word))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two neighbours' hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def marked(bits: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - width)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bit_map(buckets: DataFrame, width: int) -> np.ndarray:
    """The bit map of a column `bucket`: at most 2**(width - 6) rows of 64 bits reach the driver."""
    words = buckets.groupBy(F.shiftright("bucket", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    made = np.zeros(1 << (width - 6), np.uint64)
    made[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return made


def word_counts(rows: DataFrame) -> DataFrame:
    """group, gram, n of all words of `rows` (group, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE, 10_000):
            found = Words(batch, "group", "text")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.groups, pa.string()).take(pa.array(found.term_group)),
                    found.words.take(pa.array(found.term_word)).cast(pa.large_string()).cast(pa.string()),
                    pa.array(found.counts.astype(np.int64)),
                ],
                names=["group", "gram", "n"],
            )

    return rows.mapInArrow(work, "group string, gram string, n long").groupBy("group", "gram").agg(F.sum("n").alias("n"))


def linked(found: Words, words: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word joins the next one, hashes of these neighbours)."""
    hashes = found.hashes()
    keep = marked(words, hashes, WORD_BITS)[found.codes]
    link = np.zeros(found.many, bool)
    link[:-1] = keep[:-1] & keep[1:] & (found.piece[:-1] == found.piece[1:])
    at = np.flatnonzero(link)
    both = pair_hash(hashes[found.codes[at]], hashes[found.codes[at + 1]])
    if pairs is not None:
        link[at] = marked(pairs, both, PAIR_BITS)
    return link, both


def pair_buckets(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """How many neighbours fall into each bit of the pair map: bucket, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << PAIR_BITS, np.int32)
        for batch in slices(batches, "text", SLICE, 10_000):
            found = Words(batch, "group", "text")
            if found.many:
                _, both = linked(found, words, None)
                at, many = np.unique((both >> np.uint64(64 - PAIR_BITS)).astype(np.int64), return_counts=True)
                # A bucket that is full stays full: only whether it reaches the least count matters.
                counts[at] = np.minimum(counts[at].astype(np.int64) + many, 1 << 30)
        at = np.flatnonzero(counts)
        for start in range(0, len(at), 100_000):
            part = at[start : start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["bucket", "n"]
            )

    return rows.mapInArrow(work, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n"))


def edges_and_ends(rows: DataFrame, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """group, size, gram, n: the edges (LONGEST words) and the last 2 to LONGEST - 1 words of the pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE, 10_000):
            found = Words(batch, "group", "text")
            if not found.many:
                continue
            link, _ = linked(found, words, pairs)
            texts = found.words.cast(pa.large_string())
            # through[k]: the k words from here on belong together.
            through = np.ones(found.many, bool)
            for size in range(2, LONGEST + 1):
                step = np.zeros(found.many, bool)
                step[: max(0, found.many - size + 2)] = link[size - 2 :]
                through = through & step
                at = np.flatnonzero(through)
                if size < LONGEST:
                    at = at[~link[at + size - 1]]
                for start in range(0, len(at), 100_000):
                    yield grams(found, texts, at[start : start + 100_000], size)

    counted = rows.mapInArrow(work, "group string, size int, gram string")
    return counted.groupBy("group", "size", "gram").agg(F.count(F.lit(1)).alias("n"))


def grams(found: Words, texts: pa.Array, at: np.ndarray, size: int) -> pa.RecordBatch:
    parts = [texts.take(pa.array(found.term_word[found.codes[at + k]])) for k in range(size)]
    joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    groups = pa.array(found.groups, pa.string()).take(pa.array(found.term_group[found.codes[at]]))
    return pa.RecordBatch.from_arrays(
        [groups, pa.array(np.full(len(at), size, np.int32)), joined.cast(pa.string())], names=["group", "size", "gram"]
    )


def first_words(gram: Column, many: int) -> Column:
    return F.substring_index(gram, " ", many)


def last_words(gram: Column, many: int) -> Column:
    return F.substring_index(gram, " ", -many)


def phrase_counts(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(group, size, gram, n of all phrases of 1 to LONGEST words that occur at least `least` times; group, total)."""
    counts = stored(word_counts(rows), "phrase-words")
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    frequent = counts.filter(F.col("n") >= least)
    bucket = F.shiftrightunsigned(F.xxhash64("group", "gram"), 64 - WORD_BITS)
    words = bit_map(frequent.select(bucket.alias("bucket")), WORD_BITS)
    full = pair_buckets(rows, words).filter(F.col("n") >= least)
    pairs = bit_map(full.select(F.col("bucket").cast("long").alias("bucket")), PAIR_BITS)
    graph = stored(edges_and_ends(rows, words, pairs), "phrase-edges")
    found = frequent.select("group", F.lit(1).alias("size"), "gram", "n")
    flow = graph.filter(F.col("size") == LONGEST)
    for size in range(LONGEST, 1, -1):
        if size < LONGEST:
            through = flow.select("group", first_words(F.col("gram"), size).alias("gram"), "n")
            ends = graph.filter(F.col("size") == size).select("group", "gram", "n")
            flow = through.unionByName(ends).groupBy("group", "gram").agg(F.sum("n").alias("n"))
            flow = stored(flow, f"phrase-flow-{size}")
        kept = flow.filter(F.col("n") >= least)
        found = found.unionByName(kept.select("group", F.lit(size).alias("size"), "gram", "n"))
    return stored(found, "phrase-counts"), totals


def compacted(counts: DataFrame) -> DataFrame:
    """The phrases of two words and more that no longer phrase of the same count contains.

    A node is merged into an edge that carries its whole flow.  One word more is enough to look at:
    whatever lies between a phrase and a longer one of its count has that count too.
    """
    parts = None
    for size in range(2, LONGEST):
        longer = counts.filter(F.col("size") == size + 1)
        for cut in (first_words, last_words):
            part = longer.select("group", F.lit(size).alias("size"), cut(F.col("gram"), size).alias("gram"), "n")
            parts = part if parts is None else parts.unionByName(part)
    widest = parts.groupBy("group", "size", "gram").agg(F.max("n").alias("_widest"))
    nodes = counts.filter(F.col("size") >= 2).join(widest, ["group", "size", "gram"], "left")
    return nodes.filter(F.coalesce("_widest", F.lit(0)) < F.col("n")).drop("_widest")


def whole(name: str) -> Column:
    return F.col(name).cast(T.DecimalType(19, 0))


def scored(nodes: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases with their lowest-scoring cut: group, gram, a, l, r, total, score."""
    cuts = nodes.select(
        "group",
        "gram",
        F.col("n").alias("a"),
        "size",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"),
    )
    cuts = cuts.withColumn("_left", F.expr("substring_index(gram, ' ', cut)")).withColumn(
        "_right", F.expr("substring_index(gram, ' ', cut - size)")
    )
    known = counts.filter(F.col("size") < LONGEST)
    left = known.select("group", F.col("gram").alias("_left"), F.col("n").alias("l"))
    right = known.select("group", F.col("gram").alias("_right"), F.col("n").alias("r"))
    judged = cuts.join(left, ["group", "_left"]).join(right, ["group", "_right"]).join(totals, "group")
    top = F.lit(1000).cast(T.DecimalType(4, 0)) * whole("a") * whole("total")
    judged = judged.withColumn("_top", top).withColumn("_below", whole("l") * whole("r"))
    judged = judged.withColumn("score", F.expr("_top div _below"))
    best = judged.groupBy("group", "gram").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("_cut"), F.first("a").alias("a"), F.first("total").alias("total")
    )
    return best.select("group", "gram", "a", "_cut.l", "_cut.r", "total", "_cut.score")


def mine_phrases(
    df: DataFrame, group: str = "lang", text: str = "text", least: int = LEAST, best: int = BEST
) -> DataFrame:
    """The first `best` phrases of each group: group column, rank, phrase, a, l, r, n, score.

    least: the fewest occurrences of a candidate.
    """
    rows = df.select(
        F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("group"), F.coalesce(text, F.lit("")).alias("text")
    )
    counts, totals = phrase_counts(rows, least)
    found = scored(compacted(counts), counts, totals)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("gram").asc()]
    # A group's shares each bring their best, so no task sees all phrases of a group.
    share = Window.partitionBy("group", "_share").orderBy(*order)
    found = found.withColumn("_share", F.pmod(F.xxhash64("gram"), F.lit(SHARES)))
    found = found.withColumn("_rank", F.row_number().over(share)).filter(F.col("_rank") <= best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)))
    return ranked.filter(F.col("rank") <= best).select(
        F.col("group").alias(group),
        F.col("rank").cast("long"),
        F.col("gram").alias("phrase"),
        "a",
        "l",
        "r",
        F.col("total").alias("n"),
        F.col("score").cast("long"),
    )
