from pyspark.sql import functions as F

from tracesift.shared import scratch_path
from tracesift.sources import binary_log, container, log_format

KINDS = {1: "DEF", 2: "CONDITION", 3: "LEN", 4: "LINE"}


def events(spark, runs, each):
    made = spark.range(runs * each).select((F.col("id") % runs).alias("run_id"), (F.floor(F.col("id") / runs) + 1).alias("seq"))
    kind = F.element_at(F.array(*map(F.lit, KINDS.values())), (F.col("seq") % 4 + 1).cast("int"))
    value = F.col("run_id") + F.col("seq") / 4
    return made.select("run_id", "seq", kind.alias("event_type"), (F.col("seq") % 4 + 1).alias("event_id"), F.lit(9).cast("long").alias("var_id"), value.alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("binary").alias("value_bin"), F.lit("float").alias("value_type"), (F.col("seq") % 8 > 3).alias("value_bool"), F.lit(3).cast("long").alias("length"))


def test_logs_are_streamed(spark):
    """No group per run in Python, and stretches as before."""
    logs = binary_log.encode_logs(events(spark, 50, 40), stretch=16)
    assert "InPandas" not in logs._jdf.queryExecution().executedPlan().toString()
    known = spark.createDataFrame(list(KINDS.items()), "event_id long, event_type string")
    back = binary_log.decode_logs(logs, known)
    assert "InPandas" not in back._jdf.queryExecution().executedPlan().toString()
    rows = back.select("run_id", (F.col("chunk") * 16 + F.col("seq")).alias("seq"), "event_type", "value_num", "value_bool", "length").collect()
    num = lambda run, n: run + n / 4 if n % 4 == 0 else None
    want = [(run, n, KINDS[n % 4 + 1], num(run, n), n % 8 > 3 if n % 4 == 1 else None, 3 if n % 4 == 2 else None) for run in range(50) for n in range(1, 41)]
    assert sorted(map(tuple, rows), key=lambda r: r[:2]) == want


def test_records_as_tuples():
    values = ("v", "x" * 300, b"raw", 7, 2**80, True, None, 1.5)
    log = b"".join(binary_log.encode_record("DEF", 1, 5, binary_log.write_scalar(v), type(v).__name__) + binary_log.encode_record("CONDITION", 2, truth=True) for v in values)
    names = [c.split()[0] for c in binary_log.DYNAMIC.split(", ")]
    for cut in (len(log), len(log) - 1, 9):
        got = [dict(zip(names, r, strict=True)) for r in binary_log.value_rows(log[:cut], KINDS)]
        assert got == list(binary_log.decode(log[:cut], KINDS))
    assert [r[0] for r in binary_log.value_rows(log, KINDS, {"CONDITION"})] == list(range(2, 17, 2))


def test_reading_tasks_get_equal_shares(spark):
    path = scratch_path(spark, "containers")
    logs = spark.range(4_000).select(F.col("id").alias("run_id"), F.lit(0).cast("long").alias("chunk"), F.lit(b"x" * 100).alias("content"))
    container.write_containers(logs, path, files=3)
    back = container.read_containers(spark, path)
    shares = [r["count"] for r in back.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == 4_000 and len(shares) == spark.sparkContext.defaultParallelism and max(shares) <= min(shares) + 2


def test_small_logs_share_batches(spark, tmp_path):
    known = scratch_path(spark, "kinds")
    spark.createDataFrame(list(KINDS.items()), "event_id long, event_type string").write.parquet(known)
    for n in range(200):
        (tmp_path / f"{n}.0").write_bytes(binary_log.encode_record("LINE", 4) * 3)
    reader = log_format.LogReader({"path": str(tmp_path), "kinds": known})
    (group,) = reader.partitions()
    (batch,) = reader.read(group)
    assert batch.num_rows == 600 and batch.column(1).to_pylist() == [1, 2, 3] * 200
