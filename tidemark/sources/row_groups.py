"""Parquet logs by row group: damaged groups are set aside without their file's others.

A Spark data source in Python. Footers give the row groups; each is read by itself, only the columns asked for. A partition is
one group, or a run of a file's where there are many: so a file is opened, and its footer read, once a run rather than once a group.
A group that can't be read gives one row that names it, as does a file without a readable footer; so one scan gives both the
rows and what is missing. Files are opened by their URI through Arrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Where a row comes from; error is null for rows of the log, and says what is wrong for a group that can't be read.
PLACE = "file string, row_group int, error string"

#: Partitions of one group each that a scan may have; with more groups, bytes of a run, if that leaves as many partitions.
SINGLE, RUN = 64, 32 << 20
#: Rows of a batch that goes to Spark.
ROWS = 65_536


@dataclass
class Groups(InputPartition):
    """A file's groups from first to last; -1 alone is a file that can't be opened."""

    file: str
    first: int
    last: int
    error: str | None = None


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """First and last of consecutive groups of at most limit bytes together, or of one group."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i - 1
            first, total = i, 0
        total += size
    if sizes:
        yield first, len(sizes) - 1


class RowGroupReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str):
        self.names, self.arrow, self.folder = schema.fieldNames()[:-3], to_arrow_schema(schema), folder

    def partitions(self) -> list[Groups]:
        """All row groups of every file below the folder, from footers; a file without one is a group of its own, numbered -1."""
        system, path = _opened(self.folder)
        info = system.get_file_info(path)
        found = [info] if info.type == pa.fs.FileType.File else system.get_file_info(pa.fs.FileSelector(path, recursive=True))
        files = sorted(x.path for x in found if x.type == pa.fs.FileType.File and not x.base_name.startswith(("_", ".")))
        sizes, out = {}, []
        for file in files:
            try:
                with system.open_input_file(file) as source:
                    meta = pq.ParquetFile(source).metadata
                sizes[file] = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
            except (OSError, pa.ArrowException) as e:
                out.append(Groups(file, -1, -1, _said(e)))
        many = sum(map(len, sizes.values())) > SINGLE
        limit = min(RUN, sum(map(sum, sizes.values())) // SINGLE) if many else 0
        out += [Groups(file, first, last) for file, each in sizes.items() for first, last in runs(each, limit)]
        return out or [Groups(path, -1, -1, "no files")]

    def read(self, groups: Groups) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in self._tables(groups):
            held.append(table)
            n += table.num_rows
            if n >= ROWS:
                yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS)
                held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches(max_chunksize=ROWS)

    def _tables(self, groups: Groups) -> Iterator[pa.Table]:
        """Each group's rows, or the one row that says what is wrong with it."""
        error = groups.error
        if error is None:
            try:
                system, _ = _opened(self.folder)
                with system.open_input_file(groups.file) as source:
                    file = pq.ParquetFile(source)
                    for number in range(groups.first, groups.last + 1):
                        yield self._group(file, groups.file, number)
                return
            except (OSError, pa.ArrowException) as e:
                error = _said(e)
        for number in range(groups.first, groups.last + 1):
            yield self._bad(groups.file, number, error)

    def _group(self, file: pq.ParquetFile, name: str, number: int) -> pa.Table:
        try:
            has = set(file.schema_arrow.names)
            table = file.read_row_group(number, columns=[c for c in self.names if c in has], use_threads=False)
            columns = [table.column(c).cast(self.arrow.field(c).type) if c in has else pa.nulls(table.num_rows, self.arrow.field(c).type) for c in self.names]
        except (OSError, pa.ArrowException) as e:
            return self._bad(name, number, _said(e))
        return self._placed(columns, table.num_rows, name, number, None)

    def _bad(self, name: str, number: int, error: str) -> pa.Table:
        return self._placed([pa.nulls(1, self.arrow.field(c).type) for c in self.names], 1, name, number, error)

    def _placed(self, columns: list, n: int, name: str, number: int, error: str | None) -> pa.Table:
        place = [pa.repeat(pa.scalar(v, t), n) for v, t in ((name, pa.string()), (number, pa.int32()), (error, pa.string()))]
        return pa.table([*columns, *place], schema=self.arrow)


class RowGroups(DataSource):
    """Format `row_groups`: load(folder), with the columns to read as the schema."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(schema, self.options["path"])


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def scan(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """The columns (DDL) and PLACE of every row group below folder; columns that a file lacks are null.

    rows() and quarantined() tell the two kinds apart. Write the scan if both are needed, to read the log once.
    """
    spark.dataSource.register(RowGroups)
    return spark.read.format("row_groups").schema(f"{columns}, {PLACE}").load(folder)


def rows(scanned: DataFrame) -> DataFrame:
    return scanned.where("error IS NULL").drop("file", "row_group", "error")


def quarantined(scanned: DataFrame) -> DataFrame:
    """file, row_group (-1: the whole file), error of what can't be read."""
    return scanned.where(F.col("error").isNotNull() & (F.col("error") != "no files")).select("file", "row_group", "error")
