"""Token ids in binary files of independent zstandard frames, readable document by document.

A file holds one shard: the documents of a range of ids, in ascending order of id.

- Ids are little-endian unsigned integers of `width` bytes (2 where the vocabulary allows it, else
  4) in *data frames* of at most FRAME_IDS ids.  Each is a zstandard frame of its own with content
  size and checksum.  Decompressing a whole file with any zstandard tool gives all its ids.
- Whole documents fill a *group* of data frames: one frame, or the several frames of a document
  that is longer than a frame.  Before each group stands its *index frame*, a skippable frame with
  the ids and lengths of the group's documents.
- The file ends in a *seek table* as the public seekable format of zstandard defines it: compressed
  size, size and checksum (the low half of XXH64) of every frame, index frames with size 0.

A reader takes the seek table from the end of the file, the index frames it points to, and only the
data frames of the documents it was asked for; each is checked against the table.

Writing: each task writes its shard under a name of its own and returns one row per group; Spark
commits these rows as the *manifest*, a Parquet table.  Files that the manifest doesn't name are
left by lost tasks and are never read.  Files are opened by pyarrow, so the folder may be any store
that it knows by URI and that all executors see.

Order: by id, null ids first, then by the text's hash; rows that agree in all are in any order.  A
crowded id is cut into several shards like any others.  Nulls: a null text is an empty document (the
end id alone).  Repeated rows are written each; an empty table gives an empty manifest and no file.
Texts are never cut; one text's ids are held at a time besides a frame.  Other columns aren't read.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from klaxon.llm.common import shuffle_partitions, slices
from klaxon.llm.word_ids import word_table

FRAME_IDS = 65_536
LEVEL = 3
TEXT_SLICE = 4 << 20

# Fixed values of the public formats.
SKIPPABLE_INDEX = 0x184D2A51
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = (
    "shard long, path string, width int, offset long, frame long, first long, ids long, docs long, "
    "first_doc long, last_doc long"
)
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Frame(NamedTuple):
    """One line of a seek table, with the frame's place in the file."""

    offset: int
    packed: int
    size: int
    checksum: int


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def opened(path: str, mode: str):
    """A stream on a path or URI; folders are made when writing."""
    if "://" not in path and not path.startswith("file:"):
        system, place = pa.fs.LocalFileSystem(), path
    else:
        system, place = pa.fs.FileSystem.from_uri(path)
    if mode == "read":
        return system.open_input_file(place)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)


# -- writing ---------------------------------------------------------------------------------


class Shard:
    """Writes one file; `groups` are the manifest rows made so far."""

    def __init__(self, number: int, path: str, width: int, frame_ids: int = FRAME_IDS):
        self.number, self.path, self.width, self.frame_ids = number, path, width, frame_ids
        self.out = opened(path, "write")
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.offset = self.written = self.held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.parts: list[np.ndarray] = []
        self.groups: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if self.docs and self.held + len(ids) > self.frame_ids:
            self.end_group()
        self.docs.append((doc, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)

    def put(self, data: bytes, size: int, check: int) -> None:
        self.out.write(data)
        self.table.append((len(data), size, check))
        self.offset += len(data)

    def end_group(self) -> None:
        if not self.docs:
            return
        known = [d for d, _ in self.docs if d is not None]
        self.groups.append(
            (
                self.number, self.path, self.width, self.offset, len(self.table), self.written, self.held,
                len(self.docs), min(known, default=None), max(known, default=None),
            )
        )
        index = index_body(self.docs)
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, 0, checksum(index))
        ids = np.concatenate(self.parts).astype(f"<u{self.width}")
        for at in range(0, len(ids), self.frame_ids):
            body = ids[at : at + self.frame_ids].tobytes()
            self.put(self.compressor.compress(body), len(body), checksum(body))
        self.written += self.held
        self.docs, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.end_group()
        lines = b"".join(struct.pack("<III", *line) for line in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(lines) + len(footer)) + lines + footer)
        self.out.close()


def index_body(docs: list[tuple[int | None, int]]) -> bytes:
    """Ids, lengths and null marks of a group's documents, compressed."""
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    lengths = np.array([n for _, n in docs], "<u8")
    nulls = np.array([d is None for d, _ in docs], "u1")
    return zstandard.ZstdCompressor(level=LEVEL).compress(ids.tobytes() + lengths.tobytes() + nulls.tobytes())


def write_token_files(
    df: DataFrame,
    path: str,
    folder: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    frame_ids: int = FRAME_IDS,
) -> DataFrame:
    """Encode all texts with the tokenizer file `path`, write them below `folder`, return the manifest.

    shards: how many ranges of ids (default: the shuffle partitions).  The manifest has one row per
    group: file, offset and frame number of its index frame, first id's place in the shard, counts.
    """
    spark = df.sparkSession
    ordered = (
        df.select(
            F.col(id_col).cast("long").alias("_doc"),
            F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        )
        .withColumn("_hash", F.xxhash64("_text"))
        .withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(shards or shuffle_partitions(spark), "_doc", "_hash", "_place")
        .sortWithinPartitions("_doc", "_hash", "_place")
        .select(F.spark_partition_id().cast("long").alias("_shard"), "_doc", "_text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        width = 2 if table.vocabulary <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        shard = None
        for batch in slices(batches, "_text", TEXT_SLICE):
            if shard is None and batch.num_rows:
                number = batch.column("_shard")[0].as_py()
                shard = Shard(number, f"{folder}/tokens-{number:06d}-{uuid.uuid4().hex}.zst", width, frame_ids)
            ids, ends = table.encode(batch.column("_text"))
            for i, doc in enumerate(batch.column("_doc").to_pylist()):
                shard.add(doc, np.concatenate([ids[ends[i] : ends[i + 1]], end]))
            if len(shard.groups) > 1000:
                yield manifest_batch(shard.groups)
                shard.groups = []
        if shard is not None:
            shard.close()
            yield manifest_batch(shard.groups)

    ordered.mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def manifest_batch(groups: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in MANIFEST.split(", ")]
    kinds = [pa.string() if n == "path" else pa.int32() if n == "width" else pa.int64() for n in names]
    columns = zip(*groups) if groups else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of a folder; `start` is how many ids stand before a group in the whole corpus."""
    groups = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    totals = groups.groupBy("shard").agg(F.sum("ids").alias("_total"))
    # One row per shard meets in this window.
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("_total").over(so_far), F.lit(0)).alias("_before"))
    return groups.join(before, "shard").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


# -- reading ---------------------------------------------------------------------------------


class TokenFile:
    """Reads one file: its seek table at once, frames when asked for."""

    def __init__(self, path: str):
        self.source = opened(path, "read")
        size = self.source.size()
        many, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table with checksums at the end")
        length = 12 * many + 9
        head, body = struct.unpack("<II", self.source.read_at(8, size - length - 8))
        if head != SKIPPABLE_SEEK_TABLE or body != length:
            raise ValueError(f"{path}: damaged seek table")
        lines = np.frombuffer(self.source.read_at(12 * many, size - length), "<u4").reshape(-1, 3).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lines[:, 0])])
        if offsets[-1] != size - length - 8:
            raise ValueError(f"{path}: the seek table doesn't cover the file")
        self.path = path
        self.frames = [Frame(o, *line) for o, line in zip(offsets.tolist(), lines.tolist())]
        self.decompressor = zstandard.ZstdDecompressor()
        self.decompressed = 0
        self.last: tuple[int, bytes] = (-1, b"")

    def index(self, frame: int) -> tuple[list[int | None], np.ndarray]:
        """(document ids, their lengths) of the group whose index frame this is."""
        at = self.frames[frame]
        head, size = struct.unpack("<II", self.source.read_at(8, at.offset))
        body = self.source.read_at(size, at.offset + 8)
        if head != SKIPPABLE_INDEX or checksum(body) != at.checksum:
            raise ValueError(f"{self.path}: damaged index frame {frame}")
        flat = self.decompressor.decompress(body)
        many = len(flat) // 17
        ids = np.frombuffer(flat, "<i8", many).tolist()
        nulls = np.frombuffer(flat, "u1", many, 16 * many)
        lengths = np.frombuffer(flat, "<u8", many, 8 * many).astype(np.int64)
        return [None if z else d for d, z in zip(ids, nulls.tolist())], lengths

    def data(self, frame: int) -> bytes:
        if self.last[0] == frame:
            return self.last[1]
        at = self.frames[frame]
        body = self.decompressor.decompress(self.source.read_at(at.packed, at.offset), max_output_size=at.size)
        if len(body) != at.size or checksum(body) != at.checksum:
            raise ValueError(f"{self.path}: damaged frame {frame}")
        self.decompressed += 1
        self.last = frame, body
        return body

    def ids(self, frame: int, width: int, start: int, many: int) -> np.ndarray:
        """`many` ids from place `start` of the group with this index frame, from the frames that hold them."""
        parts, at = [], 0
        for k in itertools.count(frame + 1):
            if at >= start + many or k >= len(self.frames) or not self.frames[k].size:
                break
            holds = self.frames[k].size // width
            if at + holds > start:
                own = np.frombuffer(self.data(k), f"<u{width}")
                parts.append(own[max(0, start - at) : start + many - at])
            at += holds
        return np.concatenate(parts) if parts else np.zeros(0, f"<u{width}")

    def groups(self) -> list[int]:
        """The index frames."""
        return [k for k, frame in enumerate(self.frames) if not frame.size]


@functools.lru_cache(maxsize=4)
def token_file(path: str) -> TokenFile:
    return TokenFile(path)


def document_rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [field.split()[0] for field in DOCUMENTS.split(", ")]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    if with_ids:
        arrays.append(pa.array([x.astype("<u4").tobytes() for x in columns[4]], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)


ROWS_OUT, IDS_OUT = 1000, 1 << 20


def batched(rows: Iterator[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    held, many = [], 0
    for row in rows:
        held.append(row)
        many += row[2]
        if len(held) >= ROWS_OUT or many >= IDS_OUT:
            yield document_rows(held, with_ids)
            held, many = [], 0
    yield document_rows(held, with_ids)


def document(doc: int | None, start: int, ids: np.ndarray) -> tuple:
    return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for group in batch.to_pylist():
                    file = token_file(group["path"])
                    docs, lengths = file.index(group["frame"])
                    whole = file.ids(group["frame"], group["width"], 0, int(lengths.sum()))
                    ends = np.cumsum(lengths).tolist()
                    for doc, end, many in zip(docs, ends, lengths.tolist()):
                        yield document(doc, group["start"] + end - many, whole[end - many : end])

        yield from batched(rows(), with_ids)

    spread = manifest.repartition(shuffle_partitions(manifest.sparkSession), "path", "frame")
    return spread.sortWithinPartitions("path", "frame").mapInArrow(work, DOCUMENTS + ", ids binary" * with_ids)


def document_index(manifest: DataFrame) -> DataFrame:
    """Where every document is, from the index frames alone: no data frame is decompressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                docs, lengths = token_file(group["path"]).index(group["frame"])
                before = np.cumsum(lengths) - lengths
                many = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array([group["path"]] * many, pa.string()),
                        pa.array([group["width"]] * many, pa.int32()),
                        pa.array([group["frame"]] * many, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(group["start"] + before, pa.int64()),
                    ],
                    names=["doc_id", "path", "width", "frame", "before", "n_tokens", "start"],
                )

    return manifest.mapInArrow(
        work, "doc_id long, path string, width int, frame long, before long, n_tokens long, start long"
    )


def read_selected(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose ids are in `wanted`, decompressing only the frames that hold them."""
    found = document_index(manifest).join(wanted.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in batch.to_pylist():
                    file = token_file(at["path"])
                    ids = file.ids(at["frame"], at["width"], at["before"], at["n_tokens"])
                    yield document(at["doc_id"], at["start"], ids)

        yield from batched(rows(), True)

    # Split by place, not by file alone: one file may hold most of what is wanted.
    spread = found.repartition(shuffle_partitions(manifest.sparkSession), "path", "frame")
    return spread.sortWithinPartitions("path", "frame", "before").mapInArrow(work, DOCUMENTS + ", ids binary")
