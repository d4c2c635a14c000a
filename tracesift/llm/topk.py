"""Exact top-k search by inner product, with a pivot table.

Components are turned into whole numbers, floor(SCALE * x). For vectors q and x at distance d,
2 q.x = |q|^2 + |x|^2 - d^2, and for every pivot p the distance is at least |d(q,p) - d(x,p)|; the largest
of these lower bounds over many pivots bounds the score from above. Distances to the pivots are computed once
per vector and stored with it: the pivot table.

Queries are broadcast in blocks of about QUERIES rows, each with a score that k rows of a bounded sample reach. The pivot table is read
once per block, without a shuffle. A task takes its rows in blocks of CANDIDATES and carries each query's best k from block to block:
candidates whose bound is below the k-th best so far are eliminated, the others evaluated in the order of their bounds, until
none can reach it. Only a task's best rows are shuffled, k a query at most. Pivots come from the sample, each as far from those before
as it can be; they and the sample only affect speed.

Every row is a candidate of every query but its own row, whatever their ids; rows that share an id are rows of their own.

Defined cases: vectors that are null or hold a null or non-finite component (also after scaling) take no part; rows with a null id
neither. Vectors of other lengths than the query's are scored as if padded with zeros. Ties go to the smaller id. Scores
are exact: in floating point if no product can reach 2^53, else in integers without bounds; those beyond 64 bits become the
nearest 64-bit number, and tie. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, stored, text_batches

SCALE = 256
PIVOTS, SAMPLE = 32, 2048
#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 8192
#: Candidates that a query evaluates before it first looks at its bounds again; then twice as many each time.
STEP = 256
_MOST = 2**63 - 1


def scaled(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, id and v, the scaled vector, of the rows that take part."""
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double") * float(SCALE))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), parts.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole float64 numbers, padded with zeros to width."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    if len(lengths) and (lengths == width).all():
        out[:] = flat.reshape(len(lengths), width)
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.floor(out)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        square = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
        return np.sqrt(np.maximum(square, 0))


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each as far as can be from those chosen before."""
    if not len(rows):
        return rows
    chosen = [0]
    least = distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(np.argmax(np.nan_to_num(least))))
        least = np.minimum(least, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def scores_of(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows of whole numbers with one more: 64-bit integers."""
    if exact:  # in floating point
        return (x @ q).astype(np.int64)
    whole = lambda a: np.array([int(c) for c in a.ravel()], dtype=object).reshape(a.shape)
    return np.array([max(min(int(s), _MOST), -_MOST - 1) for s in whole(x) @ whole(q)], dtype=np.int64)


@dataclass
class Queries:
    """A block of queries, with what a task needs to meet them with candidates."""

    rows: np.ndarray
    ids: np.ndarray
    v: np.ndarray
    d: np.ndarray  # distances to the pivots
    least: np.ndarray  # a score that k other rows reach
    exact: bool  # whether floating point is exact


class Best:
    """The best k rows so far of each query."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k = queries, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.rows]
        self.square = (queries.v**2).sum(axis=1)

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> None:
        """A block of candidates."""
        with np.errstate(all="ignore"):
            square = (x**2).sum(axis=1)
            columns = np.ascontiguousarray(d.T)
            for i in range(len(self.q.rows)):
                self._meet(i, rows, ids, x, columns, square)

    def _least(self, i: int) -> float:
        scores = self.found[i][1]
        return max(self.q.least[i], float(scores[-1]) if len(scores) == self.k else -np.inf)

    def _meet(self, i: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, columns: np.ndarray, square: np.ndarray) -> None:
        apart = np.zeros(len(x), dtype=columns.dtype)
        for p, own in enumerate(self.q.d[i]):
            np.maximum(apart, np.abs(columns[p] - own), out=apart)
        total = square + self.square[i]
        apart = np.maximum(np.nan_to_num(apart, nan=0.0, posinf=0.0) - 1e-5 * np.sqrt(total), 0)  # less what rounding may have added
        bound = (total - apart**2) / 2 + 1e-12 * total
        bound[~np.isfinite(bound)] = np.inf
        order = np.flatnonzero(bound >= self._least(i))
        order = order[np.argsort(-bound[order])]
        at, step = 0, STEP
        while at < len(order) and bound[order[at]] >= self._least(i):
            some = order[at : at + step]
            at, step = at + step, 2 * step
            some = some[rows[some] != self.q.rows[i]]
            scores = scores_of(x[some], self.q.v[i], self.q.exact)
            good = np.flatnonzero(scores >= self._least(i))
            if len(good):
                best_ids, best = (np.concatenate(both) for both in zip(self.found[i], (ids[some[good]], scores[good]), strict=True))
                first = np.lexsort((best_ids, ~best))[: self.k]  # a minus could leave 64 bits
                self.found[i] = best_ids[first], best[first]

    def batch(self) -> pa.RecordBatch:
        count = [len(ids) for ids, _ in self.found]
        flat = [np.concatenate([pair[n] for pair in self.found] or [np.zeros(0, np.int64)]) for n in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (np.repeat(self.q.rows, count), np.repeat(self.q.ids, count), *flat)], names=["query_row", "query_id", "vec_id", "score"])


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for every row whose id is divisible by every."""
    spark = df.sparkSession
    text_batches(spark)
    vectors = stored(scaled(df, id_col, vector_col), "vectors")
    largest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    facts = vectors.agg(F.count_if(F.col("id") % every == 0).alias("queries"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(largest), F.lit(0.0)).alias("largest")).first()
    width, exact = facts.width, facts.width * (int(facts.largest) + 1) ** 2 < 2**53  # rounded down, a number may grow by one
    chosen = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").toArrow().combine_chunks()
    sample = matrix(chosen.column("v").chunk(0), width) if len(chosen) else np.zeros((0, width))
    sample_rows = chosen.column("row").to_numpy()
    pivots = spark.sparkContext.broadcast(far_apart(sample, PIVOTS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = distances(matrix(batch.column(2), width), pivots.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(table.ravel(), np.full(len(table), table.shape[1]), pa.float32())], names=["row", "id", "v", "d"])

    table = stored(vectors.mapInArrow(measure, "row long, id long, v array<double>, d array<float>"), "pivots")

    def block(number: int, blocks: int) -> Queries:
        got = table.where((F.col("id") % every == 0) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == number)).toArrow().combine_chunks()
        v = matrix(got.column("v").chunk(0), width) if len(got) else np.zeros((0, width))
        d = got.column("d").chunk(0).flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, 0), np.float32)
        rows, least = got.column("row").to_numpy(), np.full(len(got), -np.inf)
        if exact:
            for i in range(len(rows) if len(sample) > k else 0):
                scores = (sample @ v[i])[sample_rows != rows[i]]
                least[i] = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
        return Queries(rows, got.column("id").to_numpy(), v, d, least, exact)

    def matched(shared) -> DataFrame:
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kept, size = Best(shared.value, k), [], 0

            def meet() -> None:
                columns = list(zip(*kept, strict=True))
                best.meet(*(np.concatenate(c) for c in columns))
                kept.clear()

            for batch in batches:
                kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width), batch.column(3).flatten().to_numpy().reshape(len(batch), -1)))
                size += len(batch)
                if size >= candidates:
                    meet()
                    size = 0
            if kept:
                meet()
            yield best.batch()

        return table.select("row", "id", "v", "d").mapInArrow(match, "query_row long, query_id long, vec_id long, score long")

    blocks = max(1, -(-facts.queries // queries))
    best: DataFrame | None = None
    for number in range(blocks):
        some = stored(matched(spark.sparkContext.broadcast(block(number, blocks))), "best")
        best = some if best is None else best.unionByName(some)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
