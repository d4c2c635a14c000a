import math

import pytest
from pyspark.sql import functions as F

from tracesift.functions import metrics

#: Scores for ef = 1, nf = 0, ep = 1, np = 2, as known from the literature's formulas.
KNOWN = {"Ochiai": 0.70710678, "Tarantula": 0.75, "Jaccard": 0.5, "Crosstab": 4 / 3, "Fleiss": 0.875, "GP02": 5.82842712, "Zoltar": 0.5, "DStar": 1, "Naish1": 2, "Dice": 1, "Wong1": 1, "Wong2": 0, "Euclid": math.sqrt(3)}


def scores(spark, ef, nf, ep, np):
    row = spark.range(1).select(*(F.lit(float(v)).alias(n) for n, v in (("ef", ef), ("nf", nf), ("ep", ep), ("np", np), ("f", ef + nf), ("p", ep + np))))
    return row.select(*(metrics.metric(n).alias(n) for n in metrics.FORMULAS)).first().asDict()


def test_all_are_there():
    assert len(metrics.FORMULAS) == 44


def test_known_values(spark):
    got = scores(spark, 1, 0, 1, 2)
    for name, value in KNOWN.items():
        assert got[name] == pytest.approx(value, abs=1e-8), name


def test_zero_denominators(spark):
    assert {scores(spark, 1, 0, 0, 0)[n] for n in ("DStar", "Kulczynski1", "M1", "Tarantula", "AMPLE")} == {0}
    assert scores(spark, 0, 1, 1, 1)["Zoltar"] == 0
    assert not any(math.isnan(v) or math.isinf(v) for c in ((0, 0, 0, 0), (3, 0, 0, 5), (0, 3, 5, 0)) for v in scores(spark, *c).values())


def test_large_counts(spark):
    assert scores(spark, 3e9, 1e9, 2e9, 5e9)["Ochiai2"] == pytest.approx(3 * 5 / math.sqrt(5 * 6 * 4 * 7), abs=1e-8)


def test_registered_functions(spark):
    metrics.register(spark)
    got = spark.sql("select similarity_ochiai(1, 2, 1, 0) as a, similarity_wong3(20, 0, 5, 0) as b").first()
    assert got.a == pytest.approx(KNOWN["Ochiai"], abs=1e-8) and got.b == pytest.approx(5 - 2.81, abs=1e-8)
    assert spark.range(1).select(metrics.similarity("Jaccard", *(F.lit(x) for x in (1, 2, 1, 0)))).first()[0] == 0.5
    with pytest.raises(ValueError):
        metrics.metric("nothing")
