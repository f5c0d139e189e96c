"""Streaming source over a dated archive, with (date, id) as its cursor.

An archive is a folder of Parquet files in ``date=YYYY-MM-DD`` folders that is appended in
the order of (date, id).  A batch is the rows after one cursor up to another: a restarted
stream goes on after the cursor in its checkpoint, and a row that a later file delivers again
lies at or before the cursor and isn't read again.  The driver lists folders and reads
the footers of the newest date only; files go to tasks in bundles of ``bundle_bytes``, and a task
skips the row groups whose ids lie outside its bounds.

Defined cases: an empty archive has no rows and leaves the cursor where it is; files without
rows count for nothing; columns that a file lacks are null, those that the schema lacks are not read;
a null id or date has no place in the order and is an error.
"""

from __future__ import annotations

import datetime
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BUNDLE_BYTES = 128 << 20
NO_ID = -(1 << 63)  # before every id


def _files(path: str):
    """The file system of ``path`` and the path within it."""
    from pyarrow import fs

    if re.match(r"file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Bundle(InputPartition):
    """(date, path) of files that one task reads, and the cursors around the batch."""

    files: list[tuple[str, str]]
    after: tuple[str, int]
    upto: tuple[str, int]


def id_bounds(date: str, after: tuple[str, int], upto: tuple[str, int]) -> tuple[int, int]:
    """The ids of ``date`` that a batch takes: more than the first number, at most the second."""
    low = after[1] if date == after[0] else NO_ID
    high = upto[1] if date == upto[0] else -NO_ID - 1
    return low, high


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.schema = schema
        self.path = options["path"]
        self.id = options.get("id", "id")
        self.date = options.get("date", "date")
        self.since = options.get("since", "")
        self.bundle_bytes = int(options.get("bundleBytes", BUNDLE_BYTES))

    def initialOffset(self):
        return {"date": self.since, "id": NO_ID}

    def _dates(self, first: str):
        """Folders of the dates from ``first`` on, newest first."""
        from pyarrow import fs

        system, root = _files(self.path)
        found = {}
        for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = entry.base_name
            if entry.type != fs.FileType.Directory or name.startswith(("_", ".")):
                continue
            day = name.removeprefix(f"{self.date}=")
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
                raise ValueError(f"no date: {entry.path}")
            if day >= first:
                found[day] = entry.path
        return system, sorted(found.items(), reverse=True)

    @staticmethod
    def _parts(system, folder: str):
        from pyarrow import fs

        entries = system.get_file_info(fs.FileSelector(folder))
        return sorted((e.path, e.size) for e in entries if e.type == fs.FileType.File and not e.base_name.startswith(("_", ".")))

    def _newest_id(self, system, path: str):
        """The largest id of a file: of its footer, or of the column where the footer doesn't say."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        with system.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            best = None
            for g in range(file.metadata.num_row_groups):
                span = _span(file, g, self.id)
                top = span[1] if span else pc.max(file.read_row_group(g, columns=[self.id]).column(0)).as_py()
                if top is not None and (best is None or top > best):
                    best = top
            return best

    def latestOffset(self):
        system, dates = self._dates(self.since)
        for day, folder in dates:
            with ThreadPoolExecutor(16) as pool:
                tops = [t for t in pool.map(lambda p: self._newest_id(system, p[0]), self._parts(system, folder)) if t is not None]
            if tops:
                return {"date": day, "id": max(tops)}
        return self.initialOffset()

    def partitions(self, start, end):
        after, upto = (start["date"], start["id"]), (end["date"], end["id"])
        if upto <= after:
            return []
        system, dates = self._dates(after[0])
        bundles, now, size = [], [], 0
        for day, folder in reversed(dates):
            if day > upto[0]:
                break
            for path, length in self._parts(system, folder):
                if now and size + length > self.bundle_bytes:
                    bundles.append(Bundle(now, after, upto))
                    now, size = [], 0
                now.append((day, path))
                size += length
        return [*bundles, Bundle(now, after, upto)] if now else bundles

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        system, _ = _files(self.path)
        for day, path in partition.files:
            low, high = id_bounds(day, partition.after, partition.upto)
            with system.open_input_file(path) as f:
                file = pq.ParquetFile(f)
                groups = []
                for g in range(file.metadata.num_row_groups):
                    span = _span(file, g, self.id)
                    if span is None or (span[1] > low and span[0] <= high):
                        groups.append(g)
                have = set(file.schema_arrow.names)
                columns = list(dict.fromkeys([self.id, *(n for n in want.names if n in have)]))
                for batch in file.iter_batches(row_groups=groups, columns=columns):
                    ids = batch.column(self.id)
                    if ids.null_count:
                        raise ValueError(f"no id: {path}")
                    batch = batch.filter(pc.and_(pc.greater(ids, low), pc.less_equal(ids, high)))
                    if batch.num_rows:
                        day_value = pa.array([datetime.date.fromisoformat(day)] * batch.num_rows)
                        arrays = []
                        for field in want:
                            if field.name == self.date:
                                arrays.append(day_value.cast(field.type))
                            elif field.name in have:
                                arrays.append(batch.column(field.name).cast(field.type))
                            else:
                                arrays.append(pa.nulls(batch.num_rows, field.type))
                        yield pa.RecordBatch.from_arrays(arrays, schema=want)


def _span(file, group: int, column: str):
    """(smallest, largest) id of a row group by its footer; None where it doesn't say or has nulls."""
    place = file.schema_arrow.names.index(column)
    for i in range(file.metadata.num_columns):
        part = file.metadata.row_group(group).column(i)
        if part.path_in_schema == file.schema_arrow.names[place]:
            stats = part.statistics
            return (stats.min, stats.max) if stats is not None and stats.has_min_max and stats.null_count == 0 else None
    return None


class ArchiveSource(DataSource):
    """``spark.readStream.format("dated_archive")`` with ``path`` and, if they differ, the names of ``id`` and ``date``.

    ``since`` leaves out earlier dates.  The schema has to be given.
    """

    @classmethod
    def name(cls):
        return "dated_archive"

    def streamReader(self, schema):
        return ArchiveStream(schema, self.options)


def archive_stream(spark: SparkSession, path: str, schema, id_col: str = "id", date_col: str = "date", since: str | None = None) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    r = spark.readStream.format(ArchiveSource.name()).schema(schema).option("id", id_col).option("date", date_col)
    return (r.option("since", since) if since else r).load(path)


def pull_archive(
    spark: SparkSession, path: str, schema, target: str, checkpoint: str, id_col: str = "id", date_col: str = "date", since: str | None = None
) -> DataFrame:
    """Append what lies after the cursor in ``checkpoint`` to ``target`` and read all of it.

    Batches don't overlap, so a row that the files of one batch hold twice is counted once
    by a look at that batch alone.  A batch is a folder of its own: one that is repeated after
    a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([date_col, id_col]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = archive_stream(spark, path, schema, id_col, date_col, since)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(target)
