import json

import pytest
from pyspark.sql import functions as F

from tracesift.operators import counts, extractors
from tracesift.sources import binary_log, csv_log, mapping, reports


def test_codec():
    assert binary_log.put_number(0) == bytes([1, 0]) and binary_log.put_number(256) == bytes([2, 1, 0]) and binary_log.put_number(65536) == bytes([3, 1, 0, 0])
    assert binary_log.encode_record("DEF", 0, 0, b"", "Int") == bytes([1, 0, 1, 0, 0, 0, 0, 0, 0, 3]) + b"Int"
    assert binary_log.encode_record("DEF", 256, 255, bytes([1, 2, 3, 4]), "Int") == bytes([2, 1, 0, 1, 255, 0, 0, 0, 4, 1, 2, 3, 4, 0, 3]) + b"Int"
    for value in (None, True, False, 0, 255, 256, -1, 70000, 2**40, -(2**70), 1.5, "", "aé", "x" * 300, b"", b"\0", b"y" * 300):
        assert binary_log.read_scalar(binary_log.write_scalar(value)) == value
    import pickle

    for bad in ([1], {"a": 1}, print):
        with pytest.raises((ValueError, TypeError)):
            binary_log.read_scalar(pickle.dumps(bad, protocol=4))


def test_broken_log_ends_quietly():
    kinds = {1: "DEF", 2: "CONDITION", 3: "LEN", 4: "LINE"}
    log = binary_log.encode_record("DEF", 1, 7, binary_log.write_scalar("v"), "str") + binary_log.encode_record("CONDITION", 2, truth=True) + binary_log.encode_record("LEN", 3, 8, length=300) + binary_log.encode_record("LINE", 4)
    rows = list(binary_log.decode(log, kinds))
    assert [r["event_id"] for r in rows] == [1, 2, 3, 4] and rows[0]["value_str"] == "v" and rows[1]["value_bool"] and rows[2]["length"] == 300
    for cut in range(len(log)):
        assert len(list(binary_log.decode(log[:cut], kinds))) <= 4
    assert [r["event_id"] for r in binary_log.decode(log + binary_log.put_number(99) + log, kinds)] == [1, 2, 3, 4]


def test_binary_files(spark, tmp_path):
    for run, n in (("a", 2), ("b", 3)):
        (tmp_path / run).write_bytes(b"".join(binary_log.encode_record("LINE", 4) for _ in range(n)))
    (tmp_path / "empty").write_bytes(b"")
    known = spark.createDataFrame([(4, "LINE", "f", 9)], "event_id long, event_type string, file string, line int")
    got = binary_log.decode_logs(binary_log.log_files(spark, str(tmp_path)), known).groupBy("path").agg(F.count("*").alias("n"), F.max("line").alias("line")).collect()
    assert sorted((r.path[-1], r.n, r.line) for r in got) == [("a", 2, 9), ("b", 3, 9)]


def test_csv_logs(spark, tmp_path):
    logs = {"passing/0": "0,main.py,1,0\r\n1,main.py,6,1,0,1\r\n0,main.py,7,2\r\n", "passing/1": "0,main.py,1,0\r\nbroken\r\n0,main.py,7,2\r\n", "failing/2": "0,main.py,1,0\r\n1,main.py,6,1,1,0\r\n", "failing/3": ""}
    for name, text in logs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = csv_log.read_csv_logs(spark, str(tmp_path), F.regexp_extract(F.col("_metadata.file_path"), "([0-9]+)$", 1).cast("long"))
    rows = sorted((r.run_id, r.seq, r.event_type, r.line, r.then_id) for r in got.collect())
    assert rows == [(0, 1, "LINE", 1, None), (0, 2, "BRANCH", 6, 0), (0, 3, "LINE", 7, None), (1, 1, "LINE", 1, None), (2, 1, "LINE", 1, None), (2, 2, "BRANCH", 6, 1)]
    registry = mapping.run_registry(spark, f"{tmp_path}/passing", f"{tmp_path}/failing")
    assert sorted((r.run_id, r.path[-1], r.failing) for r in registry.collect()) == [(0, "0", False), (1, "1", False), (2, "2", True), (3, "3", True)]
    made = counts.contingency(extractors.lines(got), registry)
    assert {r.line: (r.ef, r.nf, r.ep, r.np) for r in made.collect()} == {1: (1, 1, 2, 0), 7: (0, 2, 1, 1)}


def test_mappings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"event_id": 1, "event_type": "LINE", "file": "a", "line": 3}, {"event_id": 2, "event_type": "DEF", "file": "a", "line": 4, "var": "x"}]))
    known = mapping.read_mapping(spark, str(tmp_path / "m.json"))
    other = known.where("event_id = 2").withColumn("file", F.lit("b")).unionByName(known.where("event_id = 1").withColumn("event_id", F.lit(5).cast("long")))
    assert sorted((r.event_id, r.file) for r in mapping.united(known, other).collect()) == [(1, "a"), (2, "b"), (5, "a")]
    moved = spark.createDataFrame([(1, 11)], "event_id long, new_id long")
    assert sorted((r.event_id, r.file) for r in mapping.translated(known, moved, other).collect()) == [(2, "a"), (5, "a"), (11, "a")]
    mapping.write_mapping(known, f"{tmp_path}/out")
    assert spark.read.schema(mapping.MAPPING).json(f"{tmp_path}/out").count() == 2
    assert mapping.valid_events(spark.createDataFrame([(1,), (9,)], "event_id long"), known).count() == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("LINE", "Ochiai", 0.5, ["a:2"]), ("LINE", "Ochiai", 1.0, ["a:1"]), ("LINE", "Jaccard", 1.0, ["a:1"])], "type string, metric string, score double, places array<string>")
    got = json.loads(reports.report(rows).first().report)
    assert [s["suspiciousness"] for s in got["Ochiai"]] == [1.0, 0.5] and got["Jaccard"][0]["locations"] == ["a:1"]
    (tmp_path / "r.xml").write_text('<testsuite><testcase classname="t" name="a"/><testcase classname="t" name="b"><failure message="x">no</failure></testcase><testcase classname="t" name="c"><skipped/></testcase><testcase classname="t" name="d"><skipped message="m">why</skipped></testcase><testcase classname="t" name="e"><system-out>o</system-out><system-err/></testcase><testcase classname="t" name="f"><error/></testcase></testsuite>')
    results = reports.junit_results(spark, str(tmp_path / "r.xml"))
    assert {(r.test, r.result) for r in results.collect()} == {("t::a", "PASSED"), ("t::b", "FAILED"), ("t::e", "PASSED"), ("t::f", "FAILED")}
    assert reports.consistent_runs(results, spark.createDataFrame([("t::a", "PASSED"), ("t::b", "PASSED")], "test string, result string")).count() == 1


def test_diff_places(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -3,4 +3,3 @@ def f\n keep\n-old\n+new\n keep\n-gone\n@@ -20,1 +20,0 @@\n-twenty\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n-first\n+1st"
    got = reports.diff_places(spark.createDataFrame([(1, diff)], "bug long, diff string"))
    assert sorted((r.file, r.line) for r in got.collect()) == [("x.py", n) for n in (3, 4, 5, 6, 20)] + [("y.py", 1)]
    added = "--- a/z.py\n+++ b/z.py\n@@ -5,0 +6,2 @@\n+one\n+two\n@@ -9,2 +12,4 @@\n nine\n+more\n+more\n --- a minus\n\\ No newline at end of file"
    got = reports.diff_places(spark.createDataFrame([(1, added)], "bug long, diff string"))
    assert sorted((r.file, r.line) for r in got.collect()) == [("z.py", 6), ("z.py", 9), ("z.py", 10)]


def test_source_ranges(spark):
    text = "def f(x):\n    while x:\n        x -= 1\n    if x:\n        return 1\n    else:\n        return 2\n"
    ranges = reports.source_ranges(spark.createDataFrame([("a.py", text), ("bad.py", "def (")], "file string, text string"))
    got = {(r.kind, r.line, r.then, r.first, r["last"]) for r in ranges.collect()}
    assert got == {("FUNCTION", 1, None, 1, 7), ("FUNCTION_ERROR", 1, None, 1, 7), ("LOOP", 2, None, 2, 3), ("BRANCH", 4, True, 4, 5), ("BRANCH", 4, False, 4, 4), ("BRANCH", 4, False, 7, 7)}
    from tracesift.operators.ranking import expanded_places

    scores = spark.createDataFrame([("BRANCH", "BRANCH:a.py:4:0:then", "a.py", 4, 0.5), ("LINE", "LINE:a.py:2", "a.py", 2, 0.1)], "type string, feature string, file string, line int, score double")
    assert sorted((r.line, r.score) for r in expanded_places(scores, ranges).collect()) == [(2, 0.1), (4, 0.5), (5, 0.5)]
    assert sorted(r.line for r in expanded_places(scores, ranges, flip=True).collect()) == [2, 4, 7]


def test_names_and_outcomes(spark):
    row = spark.range(1).select(reports.safe_name(F.lit("tests/a.py::t[é 1]")).alias("a"), reports.safe_name(F.lit("x" * 300)).alias("b"), reports.test_outcome(F.lit(1), F.lit(0)).alias("c"), reports.test_outcome(F.lit(1), F.lit(1)).alias("d"), reports.test_outcome(F.lit(0), F.lit(2), F.lit(True)).alias("e")).first()
    assert row.a == "tests_a_py__t__1_" and len(row.b) == 32 and (row.c, row.d, row.e) == ("PASSING", "UNDEFINED", "UNDEFINED")
