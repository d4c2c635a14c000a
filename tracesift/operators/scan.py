"""Running aggregates over groups of any length: one window a group, or a prefix scan over stretches of it.

A window over a group puts the group into one task. Where a group is long, its rows are dealt to stretches instead: each stretch
is summed up, what precedes it is added up over the summaries, and every row adds that to its place within its own stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Rows of a group that one window takes, and places of a stretch where a group has more.
LONG, WIDTH = 1_000_000, 65_536

_FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: b),
}


def has_long(df: DataFrame, keys: list[str], most: int = LONG) -> bool:
    """Whether a group has more rows than one window should take. Counted with partial aggregation."""
    return not df.groupBy(*keys).count().where(F.col("count") > most).isEmpty()


def running(df: DataFrame, keys: list[str], at: str, order: list, values: dict[str, tuple[str, Column]], before: bool = False, long: bool | int | None = None) -> DataFrame:
    """df with a running aggregate for each name: (kind, value), of all rows of its group up to the row, or before it.

    Kinds: sum, xor, min, max, and last (the last value that isn't null). ``at`` is the number that order starts with: rows of one
    stretch share floor(at / width), nulls first. long: whether to deal groups to stretches, or how wide those are; found by counting
    unless given.
    """
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if long is None:
        long = has_long(df, keys)
    if not long:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return df.select("*", *(_FOLDS[kind][0](value).over(w).alias(name) for name, (kind, value) in values.items()))
    width = WIDTH if long is True else long
    # Structs as keys: null keys are equal, and windows, summaries and the join below share one exchange.
    rows = df.select("*", F.struct(*keys).alias("_group"), F.floor(F.col(at) / width).alias("_stretch"), *(v.alias(f"_v_{n}") for n, (_, v) in values.items()))
    rows = rows.withColumn("_key", F.struct("_group", "_stretch"))
    own = Window.partitionBy("_key").orderBy(*order)
    rows = rows.select("*", F.row_number().over(own).alias("_nth"), *(_FOLDS[kind][0](F.col(f"_v_{n}")).over(own.rowsBetween(*frame)).alias(f"_own_{n}") for n, (kind, _) in values.items()))
    rows = stored(rows, "stretches")
    total = lambda kind, c: F.max_by(c, F.when(c.isNotNull(), F.col("_nth"))) if kind == "last" else _FOLDS[kind][0](c)
    sums = rows.groupBy("_key").agg(F.first("_group").alias("_group"), F.first("_stretch").alias("_stretch"), *(total(kind, F.col(f"_v_{n}")).alias(n) for n, (kind, _) in values.items()))
    past = Window.partitionBy("_group").orderBy(F.col("_stretch").asc_nulls_first())
    carried = sums.select("_key", F.row_number().over(past).alias("_nth_stretch"), *(_FOLDS[kind][0](F.col(n)).over(past.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_past_{n}") for n, (kind, _) in values.items()))
    joined = rows.join(carried.where("_nth_stretch > 1"), "_key", "left")
    both = lambda kind, a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(_FOLDS[kind][1](a, b))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(both(kind, F.col(f"_past_{n}"), F.col(f"_own_{n}")).alias(n) for n, (kind, _) in values.items()))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by ranges of a key, with the number of their range (part), stored: ranges are drawn by sampling, and must not change."""
    return stored(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows with their number in the order of ``by``, from 0 without gaps. Each range is numbered by itself, after all before it."""
    found = dealt(rows, *by)
    sizes = found.groupBy("part").agg(F.count("*").alias("_n"))
    past = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_past"))  # a row per range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    joined = found.withColumn("_own", own).join(F.broadcast(past), "part")
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_past") + F.col("_own") - 1).cast("long").alias(name))
