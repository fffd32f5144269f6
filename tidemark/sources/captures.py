"""Link captures of any size: a data source that reads byte ranges of files, and one that writes length-prefixed records."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

RANGE = 1 << 20


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class _Ranges(InputPartition):
    """Ranges ``first`` to ``last`` (exclusive) of a file."""

    path: str
    size: int
    first: int
    last: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.range, self.beyond, self.task = int(options.get("range", RANGE)), int(options.get("beyond", 0)), int(options.get("task", 32 * RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        store, base = store_of(self.path)
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True))
        step, out = max(1, self.task // self.range), []
        for f in sorted((f for f in found if f.is_file and fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            n = -(-f.size // self.range)
            out += [_Ranges(f.path, f.size, i, min(i + step, n)) for i in range(0, n, step)]
        return out or [_Ranges("", 0, 0, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(part.path) as file:
            for i in range(part.first, part.last):
                data = file.read_at(min(self.range + self.beyond, part.size - i * self.range), i * self.range)
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([part.path]), "range": pa.array([i], pa.int64()), "at": pa.array([i * self.range], pa.int64()), "size": pa.array([part.size], pa.int64()), "data": pa.array([data], pa.binary()),
                })


class RangeSource(DataSource):
    """Format byte_ranges: (path, range, at, size, data), one row for each ``range`` bytes of each file under a path, with ``beyond`` bytes of the next range; files
    are told by ``pattern``, empty ones have no row. A task reads ``task`` bytes, a range at a time."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, range long, at long, size long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    """Files of one task, as they are called while written, without their folder's last suffix."""

    files: tuple[str, ...]


class CaptureWriter(DataSourceArrowWriter, DataSourceStreamArrowWriter):
    """Each task writes a file a segment under a name that readers don't see; the driver's commit renames all of them, an abort deletes them.

    Names of a stream's files tell batch and task: a batch that runs again replaces what an earlier try had committed of it. ``prefixed`` false writes
    the records one after another without lengths, as on the wire.
    """

    def __init__(self, options: dict):
        self.path, self.name, self.prefixed = options["path"], options.get("name", "raw_mavlink"), str(options.get("prefixed", "true")).lower() == "true"
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.path)
        context = TaskContext.get()
        tail = f"{context.partitionId():05d}.bin.inprogress-{self.job}-{context.attemptNumber()}"
        files: dict[str, pa.NativeFile] = {}
        try:
            for batch in iterator:
                for segment, record in zip(batch.column("segment").to_pylist(), batch.column("record")):
                    if record.as_py() is None:
                        continue
                    if segment not in files:
                        store.create_dir(f"{base}/{segment}", recursive=True)
                        files[segment] = store.open_output_stream(f"{base}/{segment}/{self.name}-{tail}")
                    data = record.as_py()
                    files[segment].write(struct.pack("<I", len(data)) + data if self.prefixed else data)
        finally:
            for file in files.values():
                file.close()
        return _Written(tuple(f"{base}/{segment}/{self.name}-{tail}" for segment in files))

    def _begun(self, store, base: str) -> list[str]:
        """Files of this writer's tasks, those of tries that failed included."""
        found = store.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True))
        return [f.path for f in found if f.is_file and f".bin.inprogress-{self.job}-" in f.base_name]

    def commit(self, messages: list, batch: int | None = None) -> None:
        store, base = store_of(self.path)
        mark = self.job if batch is None else f"batch{batch:08d}"
        if batch is not None:
            for f in store.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if f.is_file and f.base_name.startswith(f"{self.name}-{mark}-") and f.base_name.endswith(".bin"):
                    store.delete_file(f.path)
        for file in [f for m in messages if m is not None for f in m.files]:
            folder, name = posixpath.split(file)
            number = name.removeprefix(f"{self.name}-").split(".")[0]
            store.move(file, f"{folder}/{self.name}-{mark}-{number}.bin")
        self._clean(store, base)

    def abort(self, messages: list, batch: int | None = None) -> None:
        self._clean(*store_of(self.path))

    def _clean(self, store, base: str) -> None:
        for file in self._begun(store, base):
            store.delete_file(file)


class CaptureSource(DataSource):
    """Format raw_capture: appends rows (segment string, record binary) to files ``name``-*.bin under path/segment, each record after its length (four
    bytes, low byte first); null records are left out. Of a write that fails nothing stays; the records of a task keep their order."""

    @classmethod
    def name(cls) -> str:
        return "raw_capture"

    def schema(self) -> str:
        return "segment string, record binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptureWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return CaptureWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangeSource)
    spark.dataSource.register(CaptureSource)


def byte_ranges(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE, beyond: int = 0) -> DataFrame:
    """(path, range, at, size, data) of the files under a path; see ``RangeSource``."""
    register(spark)
    return spark.read.format("byte_ranges").option("pattern", pattern).option("range", size).option("beyond", beyond).option("task", 32 * max(size, RANGE)).load(path)


def append_raw(records: DataFrame, path: str, prefixed: bool = True) -> None:
    """Append rows (segment, record) to the raw captures under a path."""
    register(records.sparkSession)
    records.select("segment", "record").write.format("raw_capture").option("prefixed", prefixed).mode("append").save(path)


def stream_raw(records: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Start appending a stream of (segment, record) to raw captures: all that is there now, or a batch ``every`` interval."""
    register(records.sparkSession)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return records.select("segment", "record").writeStream.format("raw_capture").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)
