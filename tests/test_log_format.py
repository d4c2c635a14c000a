import random

from pyspark.sql import functions as F

from tracesift.sources import binary_log, log_format

KINDS = {1: "DEF", 2: "CONDITION", 3: "LEN", 4: "LINE", 500: "FUNCTION_EXIT"}
VALUES = ["v", "", b"raw", b"", 7, -3, 2**80, True, None, 1.5]


def log(rnd, n):
    def one():
        kind = rnd.choice(list(KINDS))
        value = rnd.choice(VALUES)
        return binary_log.encode_record(KINDS[kind], kind, 9, binary_log.write_scalar(value), type(value).__name__, rnd.random() < 0.5, 300)

    return b"".join(one() for _ in range(n))


def rows_of(path, data):
    return [(path, r["seq"], r["event_id"], KINDS[r["event_id"]], r["var_id"], r["value_num"], r["value_str"], r["value_bin"], r["value_bool"], r["value_type"], r["length"]) for r in binary_log.decode(data, KINDS)]


def plain(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=lambda r: r[:2])


def mapping(spark):
    return spark.createDataFrame(list(KINDS.items()), "event_id long, event_type string")


def test_reading_with_filters(spark, tmp_path):
    rnd = random.Random(1)
    logs = {str(tmp_path / "in" / name): log(rnd, n) for name, n in (("a", 40), ("b", 0), ("sub/c", 25), ("cut", 10), ("_hidden", 5))}
    logs[str(tmp_path / "in" / "cut")] = logs[str(tmp_path / "in" / "cut")][:-1]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for path, data in logs.items():
        open(path, "wb").write(data)
    seen = {p: d for p, d in logs.items() if "_hidden" not in p}
    df = log_format.read_logs(spark, str(tmp_path / "in"), mapping(spark))
    want = plain(r for p, d in seen.items() for r in rows_of(p, d))
    assert plain(df.collect()) == want
    some = df.where(F.col("event_type").isin("DEF", "LEN") & (F.col("path") == str(tmp_path / "in" / "a")) & (F.col("seq") > 3))
    assert plain(some.collect()) == [r for r in want if r[3] in ("DEF", "LEN") and r[0].endswith("/a") and r[1] > 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan.split("Filter", 1)[1].split("\n")[0] and "seq" in plan.split("Filter", 1)[1].split("\n")[0], plan  # what was pushed down is no filter of the plan
    assert log_format.read_logs(spark, str(tmp_path / "none"), mapping(spark)).count() == 0


def test_a_log_that_grows(spark, tmp_path):
    """Three pieces that cut records, with a restart between; the rows are those of the whole log."""
    rnd = random.Random(2)
    data = {"x": log(rnd, 60), "y": log(rnd, 30)}
    folder = tmp_path / "in"
    folder.mkdir()
    for third in range(3):
        for name, whole in data.items():
            cut = [0, len(whole) // 3 + 1, len(whole) * 2 // 3 + 1, len(whole)]
            with open(folder / name, "ab") as file:
                file.write(whole[cut[third] : cut[third + 1]])
        events = log_format.live_events(log_format.growing_logs(spark, str(folder)), KINDS)
        query = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = plain(spark.read.schema(log_format.SCHEMA).parquet(str(tmp_path / "out")).collect())
    assert got == plain(r for name, whole in data.items() for r in rows_of(str(folder / name), whole))
