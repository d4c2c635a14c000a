import math
import random

import pytest
from pyspark.sql import functions as F

from tracesift.llm.topk import top_k


def brute(rows, k, every):
    known = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for n, q, v in known:
        if q % every == 0:
            clamp = lambda s: max(min(s, 2**63 - 1), -(2**63))
            found = sorted((-clamp(sum(a * b for a, b in zip(v, w, strict=False))), i) for m, i, w in known if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) if i % 3 else rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (404, []), (406, [1.0, 2.0]), (10, [0.5] * 8), (10, [0.5] * 8), (7, [9.0] * 8), (407, [1e308] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "row": F.lit(1), "id": F.lit(0)}).repartition(5)
    for blocks in ({}, {"candidates": 64, "queries": 7}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, 5, every=10, **blocks).collect())
        assert got == brute(rows, 5, 10)


@pytest.mark.parametrize("size", [1048576.3, 1e15, 1e30, 1e200])
def test_large_numbers(spark, size):
    rnd = random.Random(5)
    rows = [(i, [size * rnd.uniform(-1, 1), rnd.uniform(-1, 1)]) for i in range(60)] + [(100, [1048576.3]), (101, [1048577.7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, 4, every=5).collect()) == brute(rows, 4, 5)


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, 5).orderBy("rank").collect()] == [(0, 1, 7, 65536), (0, 2, 7, 32768)]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, 5).collect()] == [(0, 1, 1, 65536)]
    assert top_k(df.limit(0), 5).count() == 0
    assert top_k(df.where("vec_id = 0"), 5).count() == 0
