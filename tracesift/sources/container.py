"""Logs of many runs in few files: containers, and an index of which bytes are whose.

A container is one log after the other. The index, a Parquet table sorted by run, has a row per log: run_id, chunk (which stretch of the run),
file, start and size. Tasks write containers under names of their own, and the index names those of tasks that ended well, so a task that is
run again leaves at most a file that nothing names. Reading takes the index rows that a filter leaves, and only the bytes they name.

A run comes in stretches (binary_log.STRETCH events), which are dealt to containers one by one: a run with a third of all events is spread too.
Files are opened by pyarrow, by a local path or a URI that it knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import drop_stored, stored

#: Containers that a log table is written to, bytes that a reading task is given, and bytes of an Arrow batch.
FILES, GROUP_BYTES, BATCH_BYTES = 200, 64 << 20, 8 << 20
#: Bytes that a log of no bytes counts as, when reading tasks get their shares.
LOG_COST = 64
INDEX = "run_id long, chunk long, file string, start long, size long"
_PARTS = pa.schema([("run_id", pa.int64()), ("chunk", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
_LOGS = pa.schema([("run_id", pa.int64()), ("chunk", pa.int64()), ("content", pa.binary())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_containers(logs: DataFrame, path: str, files: int = FILES) -> None:
    """logs: run_id, chunk, content, at most one row per run and chunk. Null contents are empty ones."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        name, at, out = f"{uuid.uuid4().hex}.logs", 0, None
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    store.create_dir(f"{root}/logs", recursive=True)
                    out = store.open_output_stream(f"{root}/logs/{name}")
                starts, sizes = [], []
                for content in batch.column(2):
                    data = content.as_py() or b""
                    out.write(data)
                    starts.append(at)
                    sizes.append(len(data))
                    at += len(data)
                if starts:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * len(starts)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_PARTS)
        finally:
            if out is not None:
                out.close()

    rows = logs.select(F.col("run_id").cast("long"), F.col("chunk").cast("long"), "content").repartition(files, "run_id", "chunk").sortWithinPartitions("run_id", "chunk")
    index = stored(rows.mapInArrow(put, INDEX), "container-index")  # written once: to sort the index samples it first
    index.repartitionByRange("run_id", "chunk").sortWithinPartitions("run_id", "chunk").write.parquet(f"{path}/index")
    drop_stored(index)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_containers(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """run_id, chunk and content of the logs whose index rows fit ``wanted``; of all, if none is given."""
    index = read_index(spark, path)
    index = index if wanted is None else index.where(wanted)
    facts = index.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    # Rows of a few bytes stand for megabytes: a number of tasks is given, or they would be put together again.
    tasks = max(1, min(facts.n, max(spark.sparkContext.defaultParallelism, (facts.bytes or 0) // GROUP_BYTES)))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        name, file = None, None
        for batch in batches:
            made: list[tuple] = []
            held = 0
            for run, chunk, of, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != name:
                    if file is not None:
                        file.close()
                    name, file = of, store.open_input_file(f"{root}/logs/{of}")
                file.seek(start)
                made.append((run, chunk, file.read(size)))
                held += size
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _LOGS, strict=True)], schema=_LOGS)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _LOGS, strict=True)], schema=_LOGS)
        if file is not None:
            file.close()

    # Tasks take equal shares of the bytes, in the order of the files; dealt by hashes of a few keys, some had several shares and others none.
    weight = F.col("size") + LOG_COST
    sums = index.groupBy("file").agg(F.sum(weight).alias("all"))  # a row per container
    others = sums.select("file", F.coalesce(F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum(weight).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = index.withColumn("own", F.coalesce(own, F.lit(0))).join(others, "file")
    most = max((facts.bytes or 0) + LOG_COST * facts.n, 1)
    share = F.least(F.floor((F.col("before") + F.col("own")) * tasks / most), F.lit(tasks - 1)).cast("int")
    rows = placed.repartitionById(tasks, share).sortWithinPartitions("file", "start")
    return rows.select("run_id", "chunk", "file", "start", "size").mapInArrow(get, "run_id long, chunk long, content binary")
