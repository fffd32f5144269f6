"""What Parquet parts tell in their footers: rows, the extremes of one column, bytes. No row is read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.captures import store_of

#: Footers that one task reads.
FILES = 256


@dataclass
class _Files(InputPartition):
    paths: tuple[tuple[str, int], ...]


class FooterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.column = options["path"], options.get("pattern", "*.parquet"), options["column"]

    def partitions(self) -> Sequence[InputPartition]:
        store, base = store_of(self.path)
        found = store.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True))
        hidden = lambda path: any(part[:1] in "._" for part in path[len(base) :].strip("/").split("/"))
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and not hidden(f.path))
        return [_Files(tuple(files[i : i + FILES])) for i in range(0, len(files), FILES)] or [_Files(())]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        out: dict[str, list] = {c: [] for c in ("path", "rows", "first", "last", "known", "bytes")}
        for path, size in part.paths:
            with store.open_input_file(path) as file:
                meta = pa.parquet.read_metadata(file)
            names = [meta.schema.column(i).path for i in range(meta.num_columns)]
            groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
            groups = [g for g in groups if g.num_rows]
            stats = [g.column(names.index(self.column)).statistics if self.column in names else None for g in groups]
            known = all(s is not None and s.has_min_max for s in stats)
            ends = [x for s in stats for x in (s.min, s.max)] if known else []
            for c, x in zip(out, (path, meta.num_rows, min(ends, default=None), max(ends, default=None), known, size)):
                out[c].append(x)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


class FooterSource(DataSource):
    """Format part_footers: (path, rows, first, last, known, bytes) of each Parquet file under a path; first and last of the whole numbers in ``column``, ``known``
    whether the footer has them. Hidden folders and files are left out, as Spark leaves them out."""

    @classmethod
    def name(cls) -> str:
        return "part_footers"

    def schema(self) -> str:
        return "path string, rows long, first long, last long, known boolean, bytes long"

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(dict(self.options))


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    spark.dataSource.register(FooterSource)
    return spark.read.format("part_footers").option("column", column).load(path)
