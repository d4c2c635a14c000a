"""Helpers that the training-data operators share: Arrow plumbing, free column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop_stored, shared_dir, stored

__all__ = ["add_columns", "broadcast_small", "drop_stored", "fresh", "list_array", "row_sizes", "shared_dir", "slices", "stored", "text_batches"]

#: Rows and bytes per Arrow batch handed to Python.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session in rows and bytes, unless the user has set bounds of their own. The setting
    stays, since results are computed after the call."""
    for key, default, own in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(own))


#: Bytes, as stored in rows, of a table that is broadcast; a join's hash table takes some four times as much.
BROADCAST_BYTES = 24 << 20


def row_bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes in a row; elements of arrays count as those of fixed size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((row_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def broadcast_small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its rows add up to BROADCAST_BYTES at most; else it is joined by a shuffle."""
    total = table.agg(F.sum(sum((row_bytes(f.dataType, F.col(f"`{f.name}`")) for f in table.schema.fields), F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the flat values and each row's length."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose sizes add up to about ``most``; a larger row stands alone."""
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def add_columns(df: DataFrame, source: str, fields: list[tuple[str, T.DataType]], make: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None, most: int = 4 << 20) -> DataFrame:
    """df with columns that Python makes of a source column, in Arrow batches.

    make gets some rows of the source column, of about ``most`` bytes unless one row is larger, and
    returns an array for each field. keep: the columns of df that stay (all unless given). As with
    withColumn, a new column takes the place of an old one of the same name.
    """
    text_batches(df.sparkSession)
    new = [name for name, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source_name = fresh(df, "source")
    inner = df.select(*kept, F.col(source).alias(source_name))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(name, kind) for name, kind in fields)])
    names = [*kept, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            for a, b in slices(row_sizes(column), most):
                part = column.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *make(part)], names=names)

    return inner.mapInArrow(run, schema)


def row_sizes(column: pa.Array) -> np.ndarray:
    """The bytes of each row of a string, binary or list column (lists: 4 bytes an element); 1 at least."""
    import pyarrow.compute as pc

    lists = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    sizes = pc.list_value_length(column) if lists else pc.binary_length(column)
    return np.maximum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * (4 if lists else 1), 1)
