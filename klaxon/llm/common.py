"""Table reading, held-out folds and the batch helpers the operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from klaxon.session import configure, fresh_path

# Rows of one Arrow batch.  Python works on slices of about SLICE_BYTES of text.
BATCH_ROWS = 1000
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark alone."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`query` (session first) with the package sent to the Python workers and its settings made first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        return query(configure(spark), *args)

    return run


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id is written as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES, rows: int = BATCH_ROWS
) -> Iterator[pa.RecordBatch]:
    """Cut and merge batches so that each holds about `limit` bytes of `text`, at most `rows` rows and at least one."""
    held: list[pa.RecordBatch] = []
    size = many = 0
    for batch in batches:
        column = batch.column(text)
        lengths = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            ends, _ = bytes_of(column)
            lengths = np.diff(ends)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if (size + n > limit or many == rows) and (held or i > start):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield merged(held)
                held, size, many, start = [], 0, 0, i
            size += n
            many += 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield merged(held)


def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    whole = pa.Table.from_batches(held).combine_chunks()
    return whole.to_batches(max_chunksize=max(1, whole.num_rows))[0]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n+1 rows starting at 0, the UTF-8 bytes); a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return ends - ends[0], body


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give freed memory back to the machine: workers are reused, and the next stage's heap comes on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """mapInArrow with batches small enough for whole long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return df.mapInArrow(run, schema)


def appended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of `df` followed by new fields; a field of the same name is replaced."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def with_columns(batch: pa.RecordBatch, schema_names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """`batch` with new columns, in the order of `schema_names`."""
    columns = [new[n] if n in new else batch.column(n) for n in schema_names]
    return pa.RecordBatch.from_arrays(columns, names=schema_names)
