"""Event logs as a data source of Spark: spark.read.format("event_log"), and as a stream of logs that still grow.

Reading: options path (a folder, or one log) and kinds (a Parquet table of event_id and event_type). Tasks read groups of files, and give
Arrow batches made of columns, with no object per record but its fields. Filters on path and event_type are pushed into the reader: files
and records that don't fit are skipped.

Streaming: new bytes of each file are rows (path, start, content); an offset is the size of each file. live_events() keeps for each file
what followed its last whole record as state, so that a record that was cut off is read when its rest arrives.

Files are opened by pyarrow, by a local path or a URI that it knows. Where only Spark reaches a store, binary_log.decode_logs() reads them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.streaming.state import GroupStateTimeout

from ..shared import stored
from .binary_log import BATCH, Reader, records, value_rows

#: Bytes of the files that a task reads and most of their number, and bytes of a piece of a growing file.
GROUP_BYTES, GROUP_FILES, PIECE_BYTES = 32 << 20, 5_000, 8 << 20
_FIELDS = [("path", pa.string()), ("seq", pa.int64()), ("event_id", pa.int64()), ("event_type", pa.string()), ("var_id", pa.int64()), ("value_num", pa.float64()), ("value_str", pa.string()), ("value_bin", pa.binary()), ("value_bool", pa.bool_()), ("value_type", pa.string()), ("length", pa.int64())]
SCHEMA = "path string, seq long, event_id long, event_type string, var_id long, value_num double, value_str string, value_bin binary, value_bool boolean, value_type string, length long"


def _files(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The logs below a path with their sizes, in order. Names that begin with a dot or underscore are left out."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return store, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _bytes(store: fs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with store.open_input_file(path) as file:
        file.seek(start)
        return file.read(size) if size is not None else file.read()


def _kinds(path: str) -> dict[int, str]:
    store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    table = ds.dataset(root, filesystem=store, format="parquet").to_table(["event_id", "event_type"])
    return dict(zip(table["event_id"].to_pylist(), table["event_type"].to_pylist(), strict=True))


def rows(path: str, data: bytes, kinds: dict[int, str], wanted: set[str] | None = None, reader: Reader | None = None, seq: int = 0) -> Iterator[tuple]:
    """A log's records in the order of SCHEMA, of the wanted kinds only; numbers are those of all records."""
    for at, event, var_id, *values, length in value_rows(data, kinds, wanted, reader):
        yield path, seq + at, event, kinds[event], var_id, *values, length


def batches(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records of any number of logs as columns."""
    while part := list(islice(found, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


class _Group(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kinds = options["path"], options["kinds"]
        self.paths: set[str] | None = None
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column not in ("path", "event_type") or not isinstance(f, EqualTo | In):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = "paths" if column == "path" else "wanted"
            before = getattr(self, name)
            setattr(self, name, values if before is None else before & values)

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = [[]]
        total = 0
        for path, size in _files(self.path)[1]:
            if self.paths is not None and path not in self.paths:
                continue
            if groups[-1] and (total + size > GROUP_BYTES or len(groups[-1]) == GROUP_FILES):
                groups.append([])
                total = 0
            groups[-1].append(path)
            total += size
        return [_Group(g) for g in groups]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        kinds = _kinds(self.kinds)
        store = _files(self.path)[0] if not partition.files else fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        yield from batches(row for path in partition.files for row in rows(path, _bytes(store, path), kinds, self.wanted))


class GrowingReader(DataSourceStreamReader):
    """Pieces of what was appended to each file since the last offset."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return dict(_files(self.path)[1])

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Piece(path, at, min(PIECE_BYTES, size - at)) for path, size in sorted(end.items()) for at in range(start.get(path, 0), size, PIECE_BYTES)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        content = _bytes(store, partition.path, partition.start, partition.size)
        yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.start], pa.int64()), pa.array([content], pa.binary())], names=["path", "start", "content"])


class EventLog(DataSource):
    """format("event_log"): records when read, pieces of bytes when streamed."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA if "kinds" in self.options else "path string, start long, content binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return GrowingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_logs(logs: DataFrame, path: str) -> int:
    """Writes each log (name, content) to a file of its name below a path, in tasks, and returns how many. A task that is run again writes
    the same files."""

    def put(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        n, made = 0, None
        for batch in found:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{root}/{name}".rsplit("/", 1)[0]
                if folder != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(f"{root}/{name}") as file:
                    file.write(content.as_buffer())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return logs.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def read_logs(spark: SparkSession, path: str, mapping: DataFrame) -> DataFrame:
    """Records of the logs below a path. mapping: event_id, event_type; it describes a program, and each task holds it."""
    register(spark)
    kinds = stored(mapping.select("event_id", "event_type").distinct().coalesce(1), "kinds")
    return spark.read.format("event_log").option("kinds", kinds._stored_at).load(path)


def growing_logs(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("event_log").load(path)


def live_events(pieces: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """The records of growing logs. State of a file: the number of its records so far, and the bytes after the last whole one."""
    shared = pieces.sparkSession.sparkContext.broadcast(kinds)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        seq, tail = state.get if state.exists else (0, b"")
        pieces = sorted((int(start), bytes(content)) for frame in frames for start, content in zip(frame["start"], frame["content"], strict=True))
        reader = Reader(bytes(tail) + b"".join(content for _, content in pieces))
        for batch in batches(rows(key[0], b"", shared.value, reader=reader, seq=seq)):
            yield batch.to_pandas()
        done = sum(1 for _ in records(Reader(reader.data[: reader.at]), shared.value))
        state.update((seq + done, reader.data[reader.at :]))

    return pieces.groupBy("path").applyInPandasWithState(follow, SCHEMA, "seq long, tail binary", "append", GroupStateTimeout.NoTimeout)
