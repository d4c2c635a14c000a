import random

import pytest
from pyspark.sql import functions as F

from tracesift.operators import scan


def folds(values):
    seen = [v for v in values if v is not None]
    xor = 0
    for v in seen:
        xor ^= v
    return (sum(seen), xor, min(seen), max(seen), seen[-1]) if seen else (None,) * 5


@pytest.mark.parametrize("before", [False, True])
def test_stretches_against_one_window(spark, before):
    rnd = random.Random(5)
    rows = [(g, at, i, rnd.choice([None, rnd.randint(-50, 50)])) for g in (None, 1, 2) for i, at in enumerate(sorted((rnd.randint(0, 60) for _ in range(90))))]
    rows += [(1, None, -1, 7), (3, 5, 0, None)]
    df = spark.createDataFrame(rows, "g int, at long, tie int, v long").repartition(3)
    want = {}
    for g in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(own):
            want[r[:3]] = folds([x[3] for x in own[: i + (not before)]])
    values = {kind: (kind, F.col("v")) for kind in ("sum", "xor", "min", "max", "last")}
    for long in (False, 8):
        got = scan.running(df, ["g"], "at", [F.col("at").asc_nulls_first(), "tie"], values, before=before, long=long).collect()
        assert {(r.g, r.at, r.tie): tuple(r[4:]) for r in got} == want
    assert scan.has_long(df, ["g"], 80) and not scan.has_long(df, ["g"], 100)
    assert scan.running(df.limit(0), ["g"], "at", ["at"], values, long=True).count() == 0
