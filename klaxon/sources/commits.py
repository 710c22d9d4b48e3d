"""Tables written batch by batch, with a manifest of the batches that count.

A streaming job may run a micro-batch again after a failure.  Overwriting the batch's folder keeps
a table right for whoever reads it whole, but a stream that reads it by file name would take the
new files for new rows.  So every finished batch is *committed*: one small JSON file per commit,
numbered from 0, names the run, the batch and its data files.  A (run, batch) is committed once; a
replay of it finds that and writes nothing.

`CommittedBatches` is a streaming source over such a table.  Its offsets are commit numbers and
its rows those of the files the commits name: files of attempts that never came to a commit are
not read, and a replayed batch is not read twice.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

SOURCE = "committed_batches"
COMMITS = "_commits"
# Rows of one Arrow batch of the source.
ROWS = 10_000


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("/"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


def _listed(system: pa.fs.FileSystem, folder: str, recursive: bool = False) -> list[pa.fs.FileInfo]:
    return system.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def commit_numbers(path: str) -> list[int]:
    """The numbers of all commits of a table, in order."""
    system, place = _place(path)
    names = [info.base_name for info in _listed(system, posixpath.join(place, COMMITS))]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))


def read_commit(path: str, number: int) -> dict:
    system, place = _place(path)
    with system.open_input_stream(posixpath.join(place, COMMITS, f"{number:012d}.json")) as file:
        return json.loads(file.read())


class Committed:
    """What a table's commits say: which batches of a run are in, and the next number."""

    def __init__(self, path: str):
        self.path = path
        self.next = 0
        self.batches: set[tuple[str, int]] = set()
        # Runs in the order of their first commits.
        self.runs: dict[str, int] = {}
        self.refresh()

    def refresh(self) -> None:
        numbers = commit_numbers(self.path)
        if (numbers[-1] + 1 if numbers else 0) < self.next:  # the table has been made anew
            self.next, self.batches, self.runs = 0, set(), {}
        for number in numbers:
            if number >= self.next:
                found = read_commit(self.path, number)
                self.batches.add((found["run_id"], found["batch_id"]))
                self.runs.setdefault(found["run_id"], len(self.runs))
                self.next = number + 1


_KNOWN: dict[str, Committed] = {}


def is_committed(path: str, run_id: str, batch_id: int) -> bool:
    """Whether the batch is in.  Commits once seen are remembered, so a batch costs one listing."""
    known = _KNOWN.setdefault(path, Committed(path))
    known.refresh()
    return (run_id, batch_id) in known.batches


def run_number(path: str, run_id: str) -> int:
    """A run's place among the runs of a table; a run without a commit comes after all others."""
    known = _KNOWN.setdefault(path, Committed(path))
    known.refresh()
    return known.runs.get(run_id, len(known.runs))


def committed_files(path: str, start: int, end: int) -> list[str]:
    """The data files of commits `start` to `end` (not included)."""
    found = []
    for number in commit_numbers(path):
        if start <= number < end:
            found += [posixpath.join(path, f) for f in read_commit(path, number)["files"]]
    return found


def commit_batch(path: str, run_id: str, batch_id: int) -> None:
    """Commit what lies in the batch's folder.  Called on the driver after the write has ended.

    Runs of a table take turns: one query writes it at a time.
    """
    system, place = _place(path)
    folder = posixpath.join(place, f"run_id={run_id}", f"batch_id={batch_id}")
    infos = [i for i in _listed(system, folder, recursive=True) if i.type == pa.fs.FileType.File]
    files = sorted(i.path[len(place) :].lstrip("/") for i in infos if i.base_name.endswith(".parquet"))
    known = _KNOWN.setdefault(path, Committed(path))
    known.refresh()
    if (run_id, batch_id) in known.batches:
        return
    target = posixpath.join(place, COMMITS, f"{known.next:012d}.json")
    system.create_dir(posixpath.dirname(target), recursive=True)
    # Written aside and moved, so that a reader never sees half of it.
    draft = f"{target[:-5]}.{run_id}-{batch_id}.draft"
    with system.open_output_stream(draft) as file:
        file.write(json.dumps({"run_id": run_id, "batch_id": batch_id, "files": files}).encode())
    system.move(draft, target)
    known.refresh()


class Files(InputPartition):
    def __init__(self, path: str, file: str):
        self.path, self.file = path, file


class CommittedReader(DataSourceStreamReader):
    """Offsets are numbers of commits: {"commit": n} stands after the first n."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        numbers = commit_numbers(self.path)
        return {"commit": numbers[-1] + 1 if numbers else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for number in commit_numbers(self.path):
            if start["commit"] <= number < end["commit"]:
                found += [Files(self.path, f) for f in read_commit(self.path, number)["files"]]
        # A source without a partition would not be asked for rows at all.
        return found or [Files(self.path, "")]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, place = _place(partition.path)
        wanted = to_arrow_schema(self.schema)
        folders = dict(unquote(p).split("=", 1) for p in partition.file.split("/")[:-1] if "=" in p)
        with system.open_input_file(posixpath.join(place, partition.file)) as source:
            for batch in pq.ParquetFile(source).iter_batches(ROWS):
                yield _shaped(batch, wanted, folders)

    def commit(self, end: dict) -> None:
        pass


def _shaped(batch: pa.RecordBatch, wanted: pa.Schema, folders: dict[str, str]) -> pa.RecordBatch:
    """The wanted columns; one that isn't in the file comes from its folder's name, else it is null."""
    columns = []
    for field in wanted:
        if field.name in batch.schema.names:
            column = batch.column(field.name)
        else:
            value = folders.get(field.name)
            column = pa.array([None if value == "__HIVE_DEFAULT_PARTITION__" else value] * batch.num_rows, pa.string())
        columns.append(column.cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=wanted)


class CommittedBatches(DataSource):
    """Streaming source over a table of committed batches; option `path`."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def streamReader(self, schema: StructType) -> CommittedReader:
        return CommittedReader(self.options["path"], schema)


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the committed batches of the table at `path`, each once."""
    spark.dataSource.register(CommittedBatches)
    # Files hold what was written: a column may be null there whatever the plan of its writer said.
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.readStream.format(SOURCE).schema(schema).option("path", path).load()
