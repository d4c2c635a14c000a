import random

from tracesift.operators import vectors


def test_packed_vectors(spark):
    """Several words of features, both defaults, all values; words, differences and tables against plain dictionaries."""
    rnd = random.Random(4)
    kind = lambda n: rnd.choice(["LINE", "CONDITION"]) if n % 7 else "LINE"
    features = {f"{k}:f:{n}": k for n in range(90) for k in [kind(n)]}
    default = {f: -1 if k == "CONDITION" else 0 for f, k in features.items()}
    values = {(run, f): rnd.choice([-1, 0, 1, 1]) for run in range(7) for f in features if rnd.random() < 0.4 and run != 5}
    observed = sorted({f for _, f in values})
    df = spark.createDataFrame([(r, f, features[f], v) for (r, f), v in values.items()], "run_id long, feature string, type string, value int").repartition(3)
    runs = spark.createDataFrame([(r, r % 2 == 0) for r in range(7)], "run_id long, failing boolean")
    words, dictionary = vectors.packed(df)
    assert {r.feature: r.number for r in dictionary.collect()} == {f: n for n, f in enumerate(observed)}
    full = {(r, f): values.get((r, f), default[f]) for r in range(7) for f in observed}
    assert {(r.run_id, r.feature): r.value for r in vectors.unpacked(words, dictionary, runs).collect()} == full
    pairs = spark.createDataFrame([(0, 1), (3, 5), (6, 2), (4, 4)], "a long, b long")
    got = {(r.a, r.b): r.difference for r in vectors.packed_differences(words, pairs).collect()}
    assert got == {(a, b): sum(full[a, f] != full[b, f] for f in observed) for a, b in got} and len(got) == 4
    wide = list(vectors.matrices(df, runs, most=40))
    assert [len(w.columns) - 2 for w in wide] == [40, 40, len(observed) - 80]
    for w in wide:
        for r in w.collect():
            assert all(r[f] == full[r.run_id, f] for f in w.columns[2:])
    nothing = df.limit(0)
    assert vectors.unpacked(*vectors.packed(nothing), runs).count() == 0
