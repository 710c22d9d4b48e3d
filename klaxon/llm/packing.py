"""Best-fit packing of token sequences through the configuration linear program.

Spark cuts the documents into pieces and counts the pieces of each length; those counts (at
most `capacity` numbers, whatever the input) are all that the plan is made from:

- The linear program covers the count of each length with as few bins as can be, a bin being a
  configuration: lengths with multiplicities that fit the capacity.  It is solved by
  multiplicative weights: every length has a weight that falls as it is covered, and the
  configurations of largest weight come from a knapsack dynamic program over the capacity.
- The fractional solution is rounded down in whole bins, and what is left is packed by best
  fit, in runs of equal bins.

The plan gives each (length, rank among its equals) a place by arithmetic.  Ranks are made in
groups of about RANK_GROUP pieces, so a length that a third of all pieces share is many tasks.

Nulls: a null text is an empty document: the end id alone.  Null and repeated ids are packed
like any others; pieces of rows that agree in id and length may swap their places among
themselves.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from klaxon.llm.common import map_batches, release, slices, stored
from klaxon.llm.word_ids import word_table

CAPACITY = 2048
RANK_GROUP = 1000
TEXT_SLICE = 2 << 20
# The linear program: rounds at most, configurations used from one round and how near to the
# best one they must come.
ROUNDS = 300
ROUND_CONFIGS = 128
NEAR = 0.1


def pace(lengths: int) -> tuple[float, float]:
    """(share of a count that one round may cover, how fast weights fall): finer for few lengths."""
    step = min(0.5, max(0.02, lengths / 4000))
    return step, min(30.0, 2 / step)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
IDS = T.StructField("ids", T.BinaryType())


def pieces_of(
    df: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each document's ids and `end_id`, cut where longer than `capacity`; one row per piece."""
    schema = T.StructType(PIECES.fields + ([IDS] if with_ids else []))
    width, end = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in slices(batches, "_text", TEXT_SLICE):
            ids, ends = table.encode(batch.column("_text"))
            rows: list[list] = [[] for _ in schema.names]
            for i, doc in enumerate(batch.column("_doc").to_pylist()):
                body = ids[ends[i] : ends[i + 1]].tobytes() + end
                for at in range(0, len(body), width):
                    part = body[at : at + width]
                    values = (doc, at // width, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(rows, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=schema.names)
            # What a slice took would stay with the worker, beside the heap of the executor.
            del batch, ids, ends, rows
            release()
            yield made

    held = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    return map_batches(held, work, schema)


# -- the plan, from the counts alone ---------------------------------------------------------


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value at each size up to capacity, and the last length taken there (0: none)."""
    # By falling length, so that best[size - length] is a rising run of `best`.
    worth = np.zeros(capacity + 1)
    worth[lengths] = value
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for size in range(int(lengths[0]), capacity + 1):
        sums = best[:size] + worth[size:0:-1]
        k = int(sums.argmax())
        if sums[k] > best[size - 1]:
            best[size], taken[size] = sums[k], size - k
        else:
            best[size] = best[size - 1]
    return best, taken


def fillings(start: np.ndarray, taken: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For each starting length the lengths of the best bin with it, as columns."""
    filled = np.maximum.accumulate(np.where(taken > 0, np.arange(capacity + 1), 0))
    columns, left = [start], filled[capacity - start]
    while (left > 0).any():
        item = np.where(left > 0, taken[left], 0)
        columns.append(item)
        left = filled[left - item]
    return columns


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations (falling lengths) and how many bins of each; no count is exceeded.

    A length weighs its size times exp(-sharpness * share covered); what is covered in full
    leaves the program.  In one round no length is covered by more than `step`.
    """
    step, sharpness = pace(len(lengths))
    covered = np.zeros(len(lengths))
    index = np.zeros(capacity + 1, np.int64)
    index[lengths] = np.arange(len(lengths))
    used: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        still = np.flatnonzero(covered < 1 - 1e-9)
        if not len(still):
            break
        open_lengths = lengths[still]
        value = open_lengths * np.exp(-sharpness * covered[still])
        best, taken = knapsack(value, open_lengths, capacity)
        total = value + best[capacity - open_lengths]
        order = np.argsort(-total, kind="stable")
        order = order[total[order] >= (1 - NEAR) * total.max()]
        allowed = np.zeros(len(lengths))
        allowed[still] = np.minimum(step, 1 - covered[still])
        made = 0
        for column in np.stack(fillings(open_lengths[order], taken, capacity)).T:
            places, times = np.unique(index[column[column > 0]], return_counts=True)
            bins = float((allowed[places] * counts[places] / times).min())
            if bins <= 1e-6:
                continue
            share = bins * times / counts[places]
            allowed[places] -= share
            covered[places] += share
            config = tuple(np.repeat(lengths[places], times)[::-1].tolist())
            used[config] = used.get(config, 0.0) + bins
            made += 1
            if made == ROUND_CONFIGS:
                break
    return used


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts by length, equal bins together; empties `left`."""
    made = []
    while left.any():
        room, uses = capacity, {}
        free = left.copy()
        while True:
            fitting = np.flatnonzero(free[: room + 1])
            if not len(fitting):
                break
            length = int(fitting[-1])
            times = min(int(free[length]), room // length)
            uses[length] = times
            free[length] = 0
            room -= times * length
        bins = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= bins * n
        made.append((tuple(x for x, n in uses.items() for _ in range(n)), bins))
    return made


class Plan:
    """Where each (length, rank) goes: sorted arrays, looked up by binary search."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        rows, used, sequence = [], {}, 0
        for config, count in bins:
            offset, at = 0, 0
            while at < len(config):
                length = config[at]
                times = config.count(length)
                rank = used.get(length, 0)
                rows.append((length << 48 | rank, rank, sequence, times, offset))
                used[length] = rank + times * count
                offset += times * length
                at += times
            sequence += count
        found = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys, self.ranks, self.sequences, self.times, self.offsets = found.T.copy()
        self.bins = sequence

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) | rank, side="right") - 1
        ahead = rank - self.ranks[at]
        times = self.times[at]
        return self.sequences[at] + ahead // times, self.offsets[at] + ahead % times * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The bins for pieces counted by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    lengths = np.flatnonzero(left)
    bins = []
    if len(lengths):
        solution = fractional(lengths, left[lengths], capacity)
        for config, amount in sorted(solution.items(), key=lambda x: (-x[1], x[0])):
            whole = int(amount + 1e-9)
            if whole:
                where, times = np.unique(config, return_counts=True)
                left[where] -= whole * times
                bins.append((config, whole))
    return Plan(bins + best_fit(left, capacity))


# -- ranks and places ------------------------------------------------------------------------


def ranked(pieces: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Number the pieces of each length from 0, in groups of about RANK_GROUP."""
    parts = [1 + counts.get(n, 0) // RANK_GROUP for n in range(1, capacity + 1)]
    split = F.element_at(F.split(F.lit(",".join(map(str, parts))), ","), F.col("length").cast("int"))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start"), split.cast("int")))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        grouped.groupBy("length", "_group")
        .count()
        .select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    return (
        grouped.withColumn("_nth", F.row_number().over(order))
        .join(bases, ["length", "_group"])
        .withColumn("_rank", F.col("_base") + F.col("_nth") - 1)
        .drop("_group", "_base", "_nth")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (as pieces_of gives them) with sequence_id and offset."""
    pieces = stored(pieces, "pieces")
    # At most `capacity` rows come back.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    placed = plan(counts, capacity)
    schema = T.StructType(
        pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    names = pieces.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequences, offsets = placed.places(length, rank)
            columns = [batch.column(n) for n in names] + [pa.array(sequences), pa.array(offsets)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(ranked(pieces, counts, capacity), work, schema)
