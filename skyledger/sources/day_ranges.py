"""A stored table read as disjoint day ranges: one split per range, its time bounds pushed into the file scan.

The table lies in one folder per range (`range_start=<second>`). The driver lists only these folder names; a split
opens its own folder and lets row groups outside the bounds be skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DAY_S = 86_400
FOLDER = "range_start="
# Fixed value: a second beyond all times, for a bound that is not given.
OPEN = 1 << 62


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style location; a bare path or `file:` is the local one."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else uri).lstrip("/")
    if scheme in ("s3a", "s3n"):
        scheme = "s3"
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")


@dataclass
class DayRange(InputPartition):
    """Seconds [start, end) of one folder."""

    folder: str
    start: int
    end: int


class DayRangeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path, self.column = options["path"], options.get("column", "time")
        self.first, self.last = int(options.get("first", -OPEN)), int(options.get("last", OPEN))
        self.span = int(options.get("days", 1)) * DAY_S

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the time column narrow the ranges; Spark still applies every filter to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.column,) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThanOrEqual | EqualTo):
                    self.first = max(self.first, f.value)
                if isinstance(f, GreaterThan):
                    self.first = max(self.first, f.value + 1)
                if isinstance(f, LessThanOrEqual | EqualTo):
                    self.last = min(self.last, f.value)
                if isinstance(f, LessThan):
                    self.last = min(self.last, f.value - 1)
            yield f

    def partitions(self) -> list[DayRange]:
        where, root = open_path(self.path)
        found = []
        for info in where.get_file_info(fs.FileSelector(root)):
            if not info.base_name.startswith(FOLDER) or not info.base_name[len(FOLDER):].lstrip("-").isdigit():
                continue
            begin = int(info.base_name[len(FOLDER):])
            start, end = max(begin, self.first), min(begin + self.span, self.last + 1)
            if start < end:
                found.append(DayRange(info.base_name, start, end))
        return sorted(found, key=lambda r: r.start)

    def read(self, partition: DayRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range is left
            return
        where, root = open_path(self.path)
        wanted = to_arrow_schema(self.schema)
        time = ds.field(self.column)
        table = ds.dataset(f"{root}/{partition.folder}", format="parquet", filesystem=where, schema=wanted)
        scan = table.scanner(filter=(time >= partition.start) & (time < partition.end), batch_size=16_384, batch_readahead=2, fragment_readahead=1)
        for batch in scan.to_batches():
            if batch.num_rows:
                yield batch


class DayRangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_ranges"

    def reader(self, schema: StructType) -> DayRangeReader:
        return DayRangeReader(schema, self.options)


def write_by_day_ranges(df: DataFrame, path: str, days: int = 1, column: str = "time") -> None:
    """One folder per range of `days` days; rows without a time belong to none and are left out.

    Rows move by range and time first, so a task writes to few folders and a busy range is shared by several tasks.
    """
    span = days * DAY_S
    start = F.floor(F.col(column) / span) * span
    placed = df.filter(F.col(column).isNotNull()).withColumn(FOLDER[:-1], start)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = placed.repartitionByRange(tasks, FOLDER[:-1], column)
    moved.sortWithinPartitions(FOLDER[:-1], column).write.partitionBy(FOLDER[:-1]).parquet(path)


def scan_stored_day_ranges(spark: SparkSession, path: str, schema: StructType, first: int | None = None, last: int | None = None, days: int = 1, column: str = "time") -> DataFrame:
    """Rows of [first, last] from a table written by `write_by_day_ranges` with the same number of days; None is open."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DayRangeSource)
    reader = spark.read.format("day_ranges").schema(schema)
    bounds = {name: bound for name, bound in (("first", first), ("last", last)) if bound is not None}
    return reader.options(path=path, days=days, column=column, **bounds).load()
