"""Files as a data source of Spark: `spark.read.format("textlode").load(path)` and the same as a stream.

Columns: path (below the folder), full_path, size, modified, and text (with the option `content` = `binary` bytes). Filters on
path, size and modified decide on the listing, before any file is opened. Partitions are planned by bytes, and a batch is
passed on as soon as it holds `batchBytes`, one file at least, so that a task never holds more than that and one file.

As a stream, a file is one record; the offset is the time of change and the path of the last file read. A file that is
changed is read again.

Options: `content` (text, binary), `label` (encoding), `searchZip`, `partitionBytes`, `batchBytes`. Rows: files that vanish
between listing and reading are left out; empty files have an empty text. The folder must be visible to all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from textlode.session import ship
from textlode.sources.files import contents, decode_bytes

COLUMNS = "path string, full_path string, size long, modified timestamp"
#: Defaults, in bytes.
PARTITION_BYTES, BATCH_BYTES = 128 << 20, 4 << 20


class Files(InputPartition):
    """The files of one partition: (path, full path, size, time of change in nanoseconds)."""

    def __init__(self, files: list[tuple[str, str, int, int]]) -> None:
        self.files = files


def listing(folder: str) -> Iterator[tuple[str, str, int, int]]:
    """The files below a folder."""
    top = folder.removeprefix("file://")
    for where, folders, names in os.walk(top):
        folders.sort()
        for name in sorted(names):
            full = os.path.join(where, name)
            try:
                info = os.stat(full)
            except OSError:
                continue
            yield os.path.relpath(full, top).replace(os.sep, "/"), full, info.st_size, info.st_mtime_ns


def packed(files: list[tuple[str, str, int, int]], limit: int) -> list[Files]:
    """Partitions of about `limit` bytes, in the order of the files."""
    out: list[list] = []
    room = 0
    for f in files:
        if not out or room < f[2]:
            out.append([])
            room = limit
        out[-1].append(f)
        room -= f[2] + 4096  # opening a file costs like some bytes of it
    return [Files(part) for part in out]


class Reading:
    """How the files of a partition become batches."""

    def __init__(self, options: dict) -> None:
        self.folder = options.get("path") or ""
        if not self.folder:
            raise ValueError("the source needs a path")
        self.binary = options.get("content", "text") == "binary"
        self.label, self.zip = options.get("label", "auto"), str(options.get("searchZip", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))

    def schema(self) -> str:
        return f"{COLUMNS}, {'content binary' if self.binary else 'text string'}"

    def batches(self, part: Files) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary() if self.binary else pa.string()]
        names = ["path", "full_path", "size", "modified", "content" if self.binary else "text"]
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)

        for path, full, length, changed in part.files:
            try:
                data = contents(full, self.label, self.zip, None)
            except FileNotFoundError:
                continue
            held.append((path, full, length, changed // 1000, data if self.binary else decode_bytes(data)))
            size += len(data)
            if size >= self.batch_bytes:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


def _time(value: object) -> int:
    """Nanoseconds of a timestamp literal."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=UTC)
        return int(value.timestamp() * 1_000_000) * 1000
    return int(value) * 1000


class CorpusReader(DataSourceReader):
    def __init__(self, reading: Reading) -> None:
        self.reading, self.filters = reading, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what the listing can decide; the rest goes back to Spark."""
        known = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            if isinstance(f, known) and f.attribute in (("path",), ("size",), ("modified",)) and not (f.attribute == ("modified",) and isinstance(f, In)):
                self.filters.append(f)
            elif not (isinstance(f, IsNotNull) and f.attribute in (("path",), ("size",), ("modified",))):
                yield f

    def admits(self, file: tuple[str, str, int, int]) -> bool:
        # a time has microseconds, as Spark's own
        values = {"path": file[0], "size": file[2], "modified": file[3] // 1000 * 1000}
        for f in self.filters:
            value = values[f.attribute[0]]
            given = _time(f.value) if f.attribute[0] == "modified" else f.value
            holds = {
                EqualTo: lambda: value == given, In: lambda: value in given, GreaterThan: lambda: value > given, GreaterThanOrEqual: lambda: value >= given, LessThan: lambda: value < given,
                LessThanOrEqual: lambda: value <= given, StringStartsWith: lambda: value.startswith(given), StringEndsWith: lambda: value.endswith(given), StringContains: lambda: given in value,
            }
            if not holds[type(f)]():
                return False
        return True

    def partitions(self) -> list[Files]:
        return packed([f for f in listing(self.reading.folder) if self.admits(f)], self.reading.partition_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.reading.batches(partition)


class CorpusStream(DataSourceStreamReader):
    """Files in the order of their change; of those with one time, in the order of their paths."""

    def __init__(self, reading: Reading) -> None:
        self.reading = reading

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f[3], f[0]) for f in listing(self.reading.folder)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        found = sorted((f for f in listing(self.reading.folder) if low < (f[3], f[0]) <= high), key=lambda f: (f[3], f[0]))
        return packed(found, self.reading.partition_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.reading.batches(partition)


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textlode"

    def schema(self) -> str:
        return Reading(self.options).schema()

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(Reading(self.options))

    def streamReader(self, schema) -> CorpusStream:
        return CorpusStream(Reading(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let its filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Corpus)
