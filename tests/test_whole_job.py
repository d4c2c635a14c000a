"""Queries over small tables where a part of the job would give another result."""

import datetime

from pyspark.sql import functions as F

from tracesift.operators import vectors
from tracesift.plans import localization
from tracesift.sources import binary_log


def test_whole_texts(spark, tmp_path):
    head = "word " * 100
    texts = [(1, head + "end"), (2, head + "other end"), (3, "plain tail 7"), (4, "plain é"), (5, "plain"), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = {r.doc_id: r.name for r in localization.QUERIES["safe_names"](spark, str(tmp_path)).collect()}
    assert len(names[1]) == len(names[2]) == 32 and names[1] != names[2] and names[3] == "plain_tail_7"
    for kind, want in (("EMPTY_STRING", 1), ("ASCII_STRING", 5), ("DIGIT_STRING", 1), ("SPECIAL_STRING", 5)):
        made = localization.counts_of(spark, str(tmp_path), kind).where(F.col("feature") == f"{kind}:docs:5:text").collect()
        assert [r.ef for r in made] == [want], kind


def events_table(spark, path, rows):
    """rows: event id, run, kind of row and k."""
    made = [(e, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=e), user, kind, 70.0, f'{{"k": {k}}}') for e, user, kind, k in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_all_features_and_pairs(spark, tmp_path):
    events_table(spark, tmp_path, [(1, 3, "click", 10), (2, 3, "click", 18), (3, 7, "click", 18), (4, 7, "purchase", 4), (5, 40, "signup", 5), (6, 41, "click", 10)])
    rows: dict = {}
    for r in localization.QUERIES["feature_matrix"](spark, str(tmp_path)).collect():
        rows.setdefault(r.run_id, {})[r.feature] = r.value
    assert rows[3]["LINE:f3:19"] == rows[7]["LINE:f3:19"] == 1 and rows[41]["LINE:f3:19"] == 0
    assert {c.split(":")[0] for c in rows[3]} == {"LINE", "CONDITION", "LENGTH"} and rows[40]["CONDITION:f4:5:c4:is"] == -1
    pairs = localization.QUERIES["vector_differences"](spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(3, 7), (7, 40), (40, 41)]
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_next_runs(spark):
    ids = [n * n for n in range(500)]
    got = vectors.next_runs(spark.createDataFrame([(i,) for i in ids], "run_id long").repartition(7)).collect()
    assert sorted((r.a, r.b) for r in got) == list(zip(ids, ids[1:], strict=False))


def test_mappings_over_the_bound(spark):
    """They are joined, with the same events as broadcast ones."""
    kinds = {0: "LINE", 7: "CONDITION", 300: "DEF", 2**40: "LEN", 2**63 - 1: "LINE"}
    number = binary_log.put_number
    log = b"".join(binary_log.encode_record(k, i, 9, binary_log.write_scalar(1.5), "float", True, 300) for i, k in kinds.items())
    padded = b"\x0b" + bytes(10) + b"\x07\x01" + b"\x00" + number(300)  # ids with leading zeros, and of no bytes; then it breaks off
    logs = spark.createDataFrame([(1, log), (1, log), (2, padded), (3, b""), (4, number(99) + log), (None, log)], "run_id long, content binary")
    known = spark.createDataFrame([(i, k, i % 100) for i, k in kinds.items()], "event_id long, event_type string, line long")
    want = sorted(str(r.asDict()) for r in binary_log.decode_logs(logs.where("run_id is not null"), known).collect())
    assert len(want) == 12
    for most in (0, 3):
        got = binary_log.decode_logs(logs.where("run_id is not null"), known, most).collect()
        assert sorted(str({k: r[k] for k in got[0].asDict()}) for r in got) == want
    assert binary_log.decode_logs(logs, known, 0).count() == 17
