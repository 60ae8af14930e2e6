"""Tables of Arrow files, as dataset libraries keep them: a Python data source.

A table is one file or a folder of ``.arrow`` files, in the file or the stream format, with
one schema. Files are read by ranges of record batches, a task each; a stream has no index
and is one task. Only the wanted columns are converted. Paths may be of any file system
that Arrow's own readers open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "arrow_table"
#: Bytes of a file that one task reads, about.
TASK_BYTES = 64 << 20


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the table's files."""
    system, where = _system(path)
    info = system.get_file_info(where)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(where, info.size)]
    found = system.get_file_info(pafs.FileSelector(where, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".arrow") and not f.base_name.startswith(("_", ".")))


def _open(path: str, file: str):
    """A reader of the file format, or else of the stream format."""
    source = _system(path)[0].open_input_file(file)
    try:
        return pa.ipc.open_file(source), True
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source), False


@dataclass
class BatchRange(InputPartition):
    """Record batches ``first`` to ``last - 1`` of a file; all of a stream."""

    file: str
    first: int
    last: int | None


class ArrowTable(DataSource):
    """``path``, and perhaps ``columns`` (names joined by commas) and ``task_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _whole(self) -> pa.Schema:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .arrow files in {self.options['path']}")
        reader, _ = _open(self.options["path"], files[0][0])
        return reader.schema.remove_metadata()

    def schema(self) -> T.StructType:
        whole = self._whole()
        wanted = self.options.get("columns")
        return from_arrow_schema(whole if wanted is None else pa.schema([whole.field(c) for c in wanted.split(",")]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowTableReader(self.options["path"], schema, int(self.options.get("task_bytes", TASK_BYTES)))


class ArrowTableReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, task_bytes: int):
        self.path, self.schema, self.task_bytes = path, schema, task_bytes

    def partitions(self) -> Sequence[BatchRange]:
        out = []
        for file, size in _files(self.path):
            reader, indexed = _open(self.path, file)
            self._check(file, reader.schema)
            if not indexed:
                out.append(BatchRange(file, 0, None))
                continue
            n = reader.num_record_batches
            step = max(1, n * self.task_bytes // max(1, size))
            out += [BatchRange(file, at, min(at + step, n)) for at in range(0, n, step)]
        return out or [BatchRange("", 0, 0)]

    def _check(self, file: str, found: pa.Schema) -> None:
        """Every file must hold the columns of the table, each with its type."""
        for field in self.schema.fields:
            at = found.get_field_index(field.name)
            kind = None if at < 0 else from_arrow_schema(pa.schema([found.field(at)]))[0].dataType
            if kind != field.dataType:
                raise ValueError(f"{file}: column {field.name!r} is {'missing' if kind is None else kind.simpleString()}, not {field.dataType.simpleString()}")

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        reader, indexed = _open(self.path, partition.file)
        batches = (reader.get_batch(i) for i in range(partition.first, partition.last)) if indexed else reader
        # Files may hold other Arrow types of one Spark type, e.g. long strings.
        target = to_arrow_schema(self.schema)
        for batch in batches:
            yield batch.select(self.schema.names).cast(target)


def read_arrow_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The table, or some of its columns; the others are not converted."""
    spark.dataSource.register(ArrowTable)
    reader = spark.read.format(NAME).option("path", path).option("task_bytes", task_bytes)
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    return reader.load()


def write_arrow_table(df: DataFrame, path: str, stream: bool = False) -> None:
    """One ``.arrow`` file per task, which appears under its name when it is whole.

    A task that runs twice writes the same name again.
    """
    system, where = _system(path)
    system.create_dir(where, recursive=True)
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        own, folder = _system(path)
        name = f"{folder}/part-{task.partitionId():05d}"
        rows = 0
        with own.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            with (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, schema) as writer:
                for batch in batches:
                    writer.write_batch(batch.cast(schema))
                    rows += batch.num_rows
        own.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    df.mapInArrow(run, "rows bigint").agg({"rows": "sum"}).collect()
