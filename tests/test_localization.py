"""Small traces with results worked out by hand, and random ones against a plain simulation."""

import random

import pytest
from pyspark.sql import functions as F

from tracesift.functions.metrics import metric
from tracesift.operators import counts, extractors, ranking, sequence, vectors, weights
from tracesift.schema import EVENT


def events(spark, rows):
    names = [f.name for f in EVENT.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT).repartition(3)


def line_runs(spark):
    """Two passing runs and a failing one of a function that finds the middle of three numbers."""
    traces = {0: [1, 19, 20, 5, 6, 12, 13, 16], 1: [1, 19, 20, 5, 6, 7, 9, 16], 2: [1, 19, 20, 5, 6, 7, 9, 10, 16]}
    rows = [{"run_id": r, "seq": i, "event_type": "LINE", "file": "main.py", "line": n, "event_id": n} for r, t in traces.items() for i, n in enumerate(t, 1)]
    return events(spark, rows), spark.createDataFrame([(0, False), (1, False), (2, True)], "run_id long, failing boolean")


def test_lines_of_middle(spark):
    ev, runs = line_runs(spark)
    got = {r.line: (r.ef, r.ep, r.score) for r in counts.scored(counts.contingency(extractors.lines(ev), runs)).collect()}
    assert got[10] == (1, 0, 1.0) and got[7][2] == pytest.approx(0.70710678, abs=1e-8) and got[1][2] == pytest.approx(0.57735027, abs=1e-8) and got[12][2] == 0
    best = ranking.suggestions(counts.scored(counts.contingency(extractors.lines(ev), runs))).orderBy(F.desc("score")).first()
    assert best.place == "main.py:10"


def test_branches(spark):
    sides = {0: [(6, 1, 0), (12, 6, 7)], 1: [(6, 0, 1), (7, 3, 2), (9, 5, 4)], 2: [(6, 0, 1), (7, 3, 2), (9, 4, 5)]}
    rows = [{"run_id": r, "seq": i, "event_type": "BRANCH", "file": "m", "line": n, "then_id": a, "else_id": b} for r, t in sides.items() for i, (n, a, b) in enumerate(t)]
    runs = spark.createDataFrame([(0, False), (1, False), (2, True)], "run_id long, failing boolean")
    made = counts.contingency(extractors.branches(events(spark, rows)), runs)
    got = {(r.line, r.feature.rsplit(":", 2)[1]): (r.tr, r.fr, r.ti, r.fi, r.i, r.j) for r in made.select("*", metric("IncreaseTrue").alias("i"), metric("IncreaseFalse").alias("j")).collect()}
    assert got[6, "0"] == (1, 0, 1, 1, pytest.approx(1 / 6, abs=1e-8), pytest.approx(-1 / 3, abs=1e-8))
    assert got[9, "4"] == (1, 0, 0, 1, 0.5, -0.5) and got[9, "5"] == (0, 1, 1, 0, -0.5, 0.5)
    assert got[7, "3"] == (1, 0, 1, 0, 0, -0.5) and got[12, "7"] == (0, 0, 0, 1, 0, 0)


def random_rows(seed, kinds):
    rnd = random.Random(seed)
    return [{"run_id": r, "seq": s, "thread_id": rnd.choice([None, 1]) if r == 3 else None, "event_type": rnd.choice(kinds), "file": "f", "line": rnd.randint(1, 4), "var": rnd.choice("xyz"), "var_id": 0, "value_num": float(rnd.randint(-2, 2)), "value_type": "int", "loop_id": rnd.randint(0, 1), "function": "g", "function_id": 0}
            for r in range(4) for s in range(1, 90)]


def test_scopes_and_def_use(spark):
    rows = random_rows(1, ["FUNCTION_ENTER", "FUNCTION_EXIT", "FUNCTION_ERROR", "DEF", "DEF", "USE"])
    want, uses, seen = {}, {}, {}
    for key in {(r["run_id"], r["thread_id"]) for r in rows}:
        stack, last, local, values = [], {}, {}, [{}]
        for r in (r for r in rows if (r["run_id"], r["thread_id"]) == key):
            if r["event_type"] == "FUNCTION_ENTER":
                stack.append(r["seq"])
                values.append({})
            scope = stack[-1] if stack else 0
            want[r["run_id"], r["seq"]] = (len(stack), scope)
            if r["event_type"] == "USE" and r["var"] in last:
                uses[r["run_id"], r["seq"]] = local.get((scope, r["var"]), last[r["var"]])
            if r["event_type"] == "DEF":
                last[r["var"]] = local[scope, r["var"]] = r["seq"]
                values[-1][r["var"]] = r["value_num"]
                merged = {}
                for level in values:
                    merged |= level
                seen |= {(r["run_id"], r["seq"], v): n for v, n in merged.items()}
            if r["event_type"] in ("FUNCTION_EXIT", "FUNCTION_ERROR") and stack:
                stack.pop()
                values.pop()
    ev = events(spark, rows)
    assert {(r.run_id, r.seq): (r.depth, r.scope_id) for r in sequence.with_scopes(ev).collect()} == want
    assert {(r.run_id, r.seq): r.def_seq for r in sequence.def_use(ev).collect()} == uses
    assert {(r.run_id, r.seq, r.other_var): r.other_value_num for r in sequence.visible_variables(ev).collect()} == seen


def test_loops(spark):
    rows = random_rows(2, ["LOOP_BEGIN", "LOOP_HIT", "LOOP_HIT", "LOOP_END"])
    want = {}
    stacks = {}
    for r in rows:
        stack = stacks.setdefault((r["run_id"], r["thread_id"], r["line"], r["loop_id"]), [])
        if r["event_type"] == "LOOP_BEGIN":
            stack.append(0)
        elif r["event_type"] == "LOOP_HIT":
            stack.append(stack.pop() + 1 if stack else 1)
        else:
            want[r["run_id"], r["seq"]] = stack.pop() if stack else 0
    assert {(r.run_id, r.seq): r.iterations for r in sequence.loop_counts(events(spark, rows)).collect()} == want


def test_string_predicates(spark):
    values = [("abc", "str"), ("", "str"), ("a1", "str"), ("²", "str"), ("§", "str"), ("é", "str"), ("a b", "str"), (None, "NoneType"), (None, "int")]
    rows = [{"run_id": i, "seq": 1, "event_type": "DEF", "file": "f", "line": 1, "var": "v", "value_str": s, "value_type": t} for i, (s, t) in enumerate(values)]
    made = {(r.run_id, r.type): r.truth for r in extractors.extract(events(spark, rows), "NONE", "EMPTY_STRING", "ASCII_STRING", "DIGIT_STRING", "SPECIAL_STRING").collect()}
    for i, (s, t) in enumerate(values):
        text = s if t == "str" else None
        want = {"NONE": t == "NoneType", "EMPTY_STRING": text == "", "ASCII_STRING": text is not None and text.isascii(), "DIGIT_STRING": text is not None and any(c.isdigit() for c in text), "SPECIAL_STRING": text is not None and not text.isalnum()}
        assert {k: bool(made[i, k]) for k in want} == want, s


SCORES = [0.5, 0.3, 0.7, 0.1, 0.9, 0.2, 0.8, 0.4, 0.6, 0.0]


def ranking_fixture(spark, ties):
    rows = [("a.py", n, s) for n, s in enumerate(SCORES, 1)] + [("a.py", n, 0.55) for n in (11, 12, 13)] * ties
    return ranking.ranks(spark.createDataFrame(rows, "file string, line int, score double")), spark.createDataFrame([("a.py", n) for n in (2, 6, 7, 8)], "file string, line int")


def test_ranks_and_measures(spark):
    ranked, faulty = ranking_fixture(spark, True)
    rank = {r.line: (r["rank"], r.effort) for r in ranked.collect()}
    assert [rank[n][0] for n in (2, 6, 7, 8)] == [10, 11, 2, 9] and rank[11] == (5.5, 7)
    r = ranking.fault_ranks(ranked, faulty).first()
    assert (r.exam_best, r.exam_worst, r.exam_middle, r.exam_mean) == tuple(round(x / 13, 9) for x in (2, 11, 9, 8))
    assert (r.effort_best, r.effort_worst, r.effort_middle, r.effort_mean) == (2, 11, 9, 8)
    t = ranking.top_n_expected(ranked, faulty, 5).first()
    assert (t.share, t.best, t.worst, t.average) == (pytest.approx(0.142857, abs=1e-6), pytest.approx(0.714286, abs=1e-6), pytest.approx(0.178571, abs=1e-6), pytest.approx(0.357143, abs=1e-6))
    ranked, faulty = ranking_fixture(spark, False)
    shares = {n: ranking.top_n_expected(ranked, faulty, n).first() for n in (1, 5, 10)}
    assert [shares[n].share for n in (1, 5, 10)] == [0, 0.2, 0.4] and [shares[n].average for n in (1, 5, 10)] == [0, 0.5, 1] and shares[5].best == 1
    p = ranking.precision_at(ranked, faulty, 3).first()
    assert (p.taken, p.hits, p.recall) == (3, 1, 0.25)


def test_unranked_fault(spark):
    ranked, _ = ranking_fixture(spark, False)
    r = ranking.fault_ranks(ranked, spark.createDataFrame([("b.py", 1)], "file string, line int"), total=20).first()
    assert r.exam_best == (5 + 10) / 20 and r.effort_best == 20


def test_feature_vectors(spark):
    ev, runs = line_runs(spark)
    values = vectors.complete(vectors.feature_values(extractors.lines(ev)), runs)
    got = {(r.run_id, r.feature.rsplit(":", 1)[1]): r.value for r in values.collect()}
    assert got[2, "10"] == 1 and got[0, "10"] == 0 and got[0, "12"] == 1 and got[2, "1"] == 1
    row = vectors.wide(values, runs, ["LINE:main.py:10", "LINE:main.py:12"]).where("run_id = 2").first()
    assert row["LINE:main.py:10"] == 1 and row["LINE:main.py:12"] == 0 and row.failing == 1
    d = vectors.differences(vectors.feature_values(extractors.lines(ev)), spark.createDataFrame([(1, 2)], "a long, b long")).first()
    assert d.difference == 1


def trace_of(run_id, steps):
    """Steps of a test as events: TEST_ kinds by their name, and L for a line of the program."""
    made = []
    for i, (line, kind, var) in enumerate(steps):
        program = kind == "L"
        made.append({"run_id": run_id, "seq": i, "event_type": "LINE" if program else f"TEST_{kind}", "file": "main.py" if program else "t", "line": line, "var": var, "var_id": 1})
    return made


# The order of events in the small worked tests, and the distances and weights that they must have.
CHAIN = [(1, "LINE", None), (2, "LINE", None), (7, "DEF", "a"), (8, "USE", "a"), (9, "DEF", "b"), (10, "USE", "b"), (10, "ASSERT", None), (11, "USE", "b"), (11, "ASSERT", None), (12, "USE", "a"), (12, "ASSERT", None)]


@pytest.mark.parametrize(("uses", "asserts", "want"), [(False, False, [0, 1, 2, 2, 4, 1, 6, 7]), (True, False, [0, 1, 2, 3, 1, 2, 6, 7]), (False, True, [0, 2, 3, 4, 4, 1, 6, 7]), (True, True, [0, 2, 4, 4, 1, 2, 6, 7])])
def test_def_use_distances(spark, uses, asserts, want):
    """Lines 1, 2 and 7 to 12 of a test: 7 defines a, 8 uses it, 9 defines b, 10 and 11 use and assert b, 12 a."""
    made = weights.def_use_weights(events(spark, trace_of(1, CHAIN)), uses, asserts).orderBy(F.desc("segment")).collect()
    assert [r.distance for r in made] == want


def three_tests(uses):
    """A passing test that calls f (line 2 of the program), and failing ones of f, g (6) and h (10), and of h and g; with uses, h's
    result is used once more in between."""
    more = [(16, "USE", "h")] if uses else []
    end = 16 + len(more)
    start = [(1, "LINE", None), (2, "LINE", None)]
    return [
        [*start, (7, "DEF", "f"), (2, "L", None), (8, "USE", "f"), (8, "ASSERT", None)],
        [*start, (11, "DEF", "f"), (2, "L", None), (12, "USE", "f"), (12, "ASSERT", None), (13, "DEF", "g"), (6, "L", None), (14, "USE", "g"), (14, "ASSERT", None), (15, "DEF", "h"), (10, "L", None), *more, (end, "USE", "f"), (end, "USE", "h"), (end, "ASSERT", None)],
        [*start, (19, "DEF", "h"), (10, "L", None), (20, "DEF", "g"), (6, "L", None), (21, "USE", "g"), (21, "ASSERT", None), (22, "USE", "h"), (22, "ASSERT", None)],
    ]


def line_scores(spark, tests, model, passing=()):
    ev = events(spark, [row for n, steps in enumerate(tests) for row in trace_of(n, steps)])
    observed = extractors.lines(ev)
    runs = spark.createDataFrame([(n, n not in passing) for n in range(len(tests))], "run_id long, failing boolean")
    made = weights.feature_weights(weights.segment_features(ev, observed), model(ev), runs)
    scored = counts.weighted(counts.contingency(observed, runs), made).withColumn("score", metric("Ochiai") * F.col("weight"))
    return {r.line: r.score for r in scored.collect()}


def by_hand(steps, uses):
    """A test's segments, distances and weights, event by event."""
    parts, place, source, back, began, ended, closest = [], None, {}, [], 0, None, None
    step = {"defs": [], "uses": []}

    def close():
        n = len(parts)
        parts.append(place)
        source.update(dict.fromkeys(step["defs"], n))
        known = [v for v in step["uses"] if v in source]
        back.append([source[v] for v in known])
        if uses:
            source.update(dict.fromkeys(known, n))
        step.update(defs=[], uses=[])

    started = False
    for line, kind, var in steps:
        if kind == "L":
            continue
        if place is not None and (kind == "END" or place != line):
            close()
            if kind == "END":
                closest = len(parts) - 1
        place = line
        if kind == "START" and not started:
            started, began = True, len(parts)
        if kind == "END":
            ended = (len(parts), began if started else 0)
        if kind == "DEF":
            step["defs"].append(var)
        if kind == "USE":
            step["uses"].append(var)
    close()
    n = len(parts)
    base = [(1 if ended[1] <= i < ended[0] else 0.5) if ended else (0.5 if i < began else 1) for i in range(n)]
    return parts, back, base, closest


def test_weights_with_start_and_end(spark):
    rnd = random.Random(3)
    tests = []
    for _ in range(40):
        kinds = rnd.choices(["LINE", "DEF", "USE", "ASSERT", "L", "START", "END"], [4, 3, 4, 2, 4, rnd.choice([0, 1]), rnd.choice([0, 1])], k=rnd.randint(1, 25))
        tests.append([(rnd.randint(1, 9), k, rnd.choice("abc") if k in ("DEF", "USE") else None) for k in kinds] + [(1, "LINE", None)])
    ev = events(spark, [row for n, steps in enumerate(tests) for row in trace_of(n, steps)])
    got = {(r.run_id, r.segment): r.weight for r in weights.function_weights(ev).collect()}
    lined = {(r.run_id, r.segment): (r.distance, r.weight) for r in weights.line_weights(ev).collect()}
    shortened = {uses: {(r.run_id, r.segment): (r.distance, r.weight) for r in weights.def_use_weights(ev, uses).collect()} for uses in (False, True)}
    for n, steps in enumerate(tests):
        for uses in (False, True):
            parts, back, base, closest = by_hand(steps, uses)
            last = len(parts) - 1
            assert [got[n, i] for i in range(last + 1)] == base and (n, last + 1) not in got
            distance = [last - i if closest is None else closest - 1 - i if i < closest else i - closest + 1 for i in range(last + 1)]
            assert [lined[n, i][0] for i in range(last + 1)] == distance
            assert [lined[n, i][1] for i in range(last + 1)] == pytest.approx([b * (1 - d / (max(distance) + 1)) for b, d in zip(base, distance, strict=True)])
            distance = [last - i for i in range(last + 1)]
            for i in range(last, -1, -1):
                for j in back[i]:
                    distance[j] = min(distance[j], distance[i] + 1)
            assert [shortened[uses][n, i][0] for i in range(last + 1)] == distance
            assert [shortened[uses][n, i][1] for i in range(last + 1)] == pytest.approx([b * (1 - d / (max(distance) + 1)) for b, d in zip(base, distance, strict=True)])


def test_function_weights_of_fixtures(spark):
    """A fixture before and one after: the program's lines that they call weigh half."""
    steps = [(6, "LINE", None), (2, "L", None), (12, "START", None), (13, "LINE", None), (10, "L", None), (12, "END", None), (9, "LINE", None), (6, "L", None)]
    assert line_scores(spark, [steps], weights.function_weights) == {10: 1.0, 2: 0.5, 6: 0.5}


def test_line_weights(spark):
    rows = [{"run_id": r, "seq": i, "event_type": "TEST_LINE", "file": "t", "line": n} for r, t in ((1, (1, 2, 10, 11, 12)), (2, (1, 2, 15, 16))) for i, n in enumerate(t)]
    got = {(r.run_id, r.segment): r.weight for r in weights.line_weights(events(spark, rows)).collect()}
    assert got[1, 4] == 1 and got[2, 3] == 1 and got[1, 3] == pytest.approx(0.8) and got[2, 2] == 0.75 and got[1, 2] == pytest.approx(0.6)


# Scores of lines 10, 6 and 2.
@pytest.mark.parametrize(("uses", "asserts", "want"), [(False, False, (0.85416, 0.64583, 0.4375)), (True, False, (0.80555, 0.61111, 0.38888)), (False, True, (0.85416, 0.5, 0.375)), (True, True, (0.80555, 0.47222, 0.33333))])
def test_def_use_weights(spark, uses, asserts, want):
    got = line_scores(spark, three_tests(uses), lambda e: weights.def_use_weights(e, uses, asserts), passing=[0])
    assert [got[n] for n in (10, 6, 2)] == pytest.approx(want, abs=1e-5)


def test_line_scores(spark):
    start = [(1, "LINE", None), (2, "LINE", None)]
    tests = [[*start, (7, "LINE", None), (2, "L", None)], [*start, (10, "LINE", None), (2, "L", None), (11, "LINE", None), (6, "L", None), (12, "LINE", None), (10, "L", None)], [*start, (15, "LINE", None), (6, "L", None), (16, "LINE", None), (10, "L", None)]]
    assert line_scores(spark, tests, weights.line_weights, passing=[0]) == {10: pytest.approx(1), 6: pytest.approx(0.775), 2: pytest.approx(0.3)}


def test_loops_against_a_stack(spark):
    rnd = random.Random(5)
    rows, want = [], []
    for run in range(40):
        stack = []
        for seq in range(rnd.randint(1, 40)):
            kind = rnd.choice(["BEGIN", "HIT", "HIT", "END"])
            rows.append({"run_id": run, "seq": seq, "event_type": f"LOOP_{kind}", "file": "a", "line": 1, "loop_id": 1})
            if kind == "BEGIN":
                stack.append(0)
            elif kind == "HIT":
                stack = stack[:-1] + [(stack[-1] if stack else 0) + 1]
            else:
                want.append((run, seq, stack.pop() if stack else 0))
    got = [(r.run_id, r.seq, r.iterations) for r in sequence.loop_counts(events(spark, rows)).collect()]
    assert sorted(got) == want


def test_long_loop(spark):
    """Linear in a loop's events."""
    n = 48_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("seq"), F.lit(None).cast("long").alias("thread_id"), F.when(F.col("id") == 0, "LOOP_BEGIN").when(F.col("id") == n - 1, "LOOP_END").otherwise("LOOP_HIT").alias("event_type"), F.lit("a").alias("file"), F.lit(1).alias("line"), F.lit(1).cast("long").alias("loop_id"))
    assert sequence.loop_counts(rows).first().iterations == n - 2


def test_printed_names(spark):
    rows = [("SCALAR_PAIR", "SCALAR_PAIR:a:1:x:<=:y"), ("RETURN", "RETURN:a:1:f:==:None"), ("VARIABLE", "VARIABLE:a:1:x:>"), ("FUNCTION", "FUNCTION:a:1:f"), ("DEF_USE", "DEF_USE:a:1:b:2:x"), ("BRANCH", "BRANCH:a:1:7:then"), ("CONDITION", "CONDITION:a:1:x > 0:not"), ("LENGTH", "LENGTH:a:1:x:more"), ("LOOP", "LOOP:a:1:0")]
    df = spark.createDataFrame([(t, f, "a", 1) for t, f in rows], "type string, feature string, file string, line int")
    got = [r.name for r in df.select(vectors.printed_name().alias("name")).collect()]
    assert got == ["SCALAR_PAIR:a:1:x<=y", "RETURN:a:1:f==None", "VARIABLE:a:1:x>0", "FUNCTION:a:f:1", "DEF_USE:a:1:b:2:x", "BRANCH:a:1:then:7", "CONDITION:a:1:x > 0", "LENGTH:a:1:x:evaluate_length_more", "LOOP:a:1"]


def test_empty_trace(spark):
    none = events(spark, [])
    runs = spark.createDataFrame([], "run_id long, failing boolean")
    assert counts.contingency(extractors.extract(none), runs).count() == 0


def test_folds_of_scores(spark):
    rows = [("LINE", "a", "f", 1, None, None, 0.5), ("LINE", "b", "f", 1, None, None, 0.25), ("LINE", "c", "f", 1, None, None, 0.25), ("LINE", "d", "g", 2, "f", 1, None), ("DEF_USE", "e", "g", 2, "f", 1, 1.0)]
    scores = spark.createDataFrame(rows, "type string, feature string, file string, line int, file2 string, line2 int, score double")
    fold = lambda f, **more: {(r.file, r.line): r.score for r in ranking.place_scores(scores, how=f, **more).collect()}
    assert fold(F.greatest) == {("f", 1): 1.0, ("g", 2): 1.0}
    assert fold(lambda score, so_far: so_far / 2 + score, start=0) == {("f", 1): 0.75, ("g", 2): 1.0}
    assert fold(lambda score, so_far: 2 * so_far + score, start=1) == {("f", 1): ((2 + 1) * 2 + 0.5) * 2 + 0.25, ("g", 2): 3.0}
    parts = [ranking.place_sums(scores.where(F.col("feature") < "c")), ranking.place_sums(scores.where(F.col("feature") >= "c"))]
    assert {(r.file, r.line): r.score for r in ranking.mean_of_sums(parts[0].unionByName(parts[1])).collect()} == {("f", 1): 0.5, ("g", 2): 1.0}


def test_many_faults_without_a_rank(spark):
    ranked, _ = ranking_fixture(spark, False)
    faulty = spark.range(500).select(F.lit("b.py").alias("file"), F.col("id").cast("int").alias("line"))
    r = ranking.fault_ranks(ranked, faulty.unionByName(spark.createDataFrame([("a.py", 5)], "file string, line int")), total=1000).first()
    default = (990 / 2 + 10) / 1000
    assert (r.exam_best, r.exam_worst, r.exam_middle, r.effort_best, r.effort_worst) == (1 / 1000, default, default, 1, 1000)
    assert r.exam_mean == round((0.001 + 500 * default) / 501, 9) and ranking.fault_ranks(ranked, faulty.limit(0)).count() == 0
