"""Tables of fixed size that a whole corpus is counted into, and then broadcast: their size never grows with the data."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a table that travel as one piece, and groups that tasks' pieces are first put together in.
_PIECE, _GROUPS = 1 << 14, 32
_SCHEMA = "part int, task int, packed binary"


def _pieces(table: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    for i, piece in enumerate(table.reshape(-1, _PIECE)):
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["part", "task", "packed"])


def saturating(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """a + b, or the largest number where that is larger still: a count that wrapped would look rare."""
    np.add(a, b, out=out)
    out[out < b] = np.iinfo(out.dtype).max


def whole_table(df: DataFrame, update: Callable[[np.ndarray, pa.RecordBatch], None], size: int, kind: str = "<u4", merge: Callable = saturating) -> np.ndarray:
    """A table of ``size`` numbers (a multiple of 2^14) that update() fills from each batch, merged over all tasks.

    Tasks send their tables in compressed pieces. Pieces of one place are merged as they arrive, first within groups of
    tasks and then across groups, so no task holds or reads those of all others. Only the merged table comes to the driver.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=kind)
        for batch in batches:
            update(table, batch)
        yield from _pieces(table, TaskContext.get().partitionId() % _GROUPS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                piece = np.frombuffer(zlib.decompress(packed.as_buffer()), dtype=kind)
                if part in found:
                    merge(found[part], piece, out=found[part])
                else:
                    found[part] = piece.copy()
        for part, piece in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], names=["part", "task", "packed"])

    made = df.mapInArrow(fill, _SCHEMA).repartition("part", "task").mapInArrow(add, _SCHEMA).repartition("part").mapInArrow(add, _SCHEMA)
    out = np.zeros((size // _PIECE, _PIECE), dtype=kind)
    for row in made.select("part", "packed").collect():  # one row per piece
        out[row.part] = np.frombuffer(zlib.decompress(row.packed), dtype=kind)
    return out.ravel()


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit table of the column's 64-bit hashes: lets all of them through and few others. 64 bits a key, 2^20 at least
    and 2^30 (128 MB) at most; beyond some 10^7 keys it lets more through."""
    bits = min(max((64 * keys.count()).bit_length(), 20), 30)

    def update(table: np.ndarray, batch: pa.RecordBatch) -> None:
        at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    return whole_table(keys.select(F.col(keys.columns[0]).cast("long")), update, 1 << (bits - 3), "u1", np.bitwise_or)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a key_filter() lets through."""
    at = keys.view(np.uint64) >> np.uint64(64 - (len(table).bit_length() - 1) - 3)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
