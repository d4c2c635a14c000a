import os
import random

from pyspark.sql import functions as F

from tracesift.shared import scratch_path
from tracesift.sources import container, csv_log, mapping, reports


def test_many_runs_in_few_files(spark):
    path = scratch_path(spark, "containers")
    logs = spark.range(20_000).select(F.col("id").alias("run_id"), F.lit(0).cast("long").alias("chunk"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("log "), F.col("id").cast("string")).cast("binary")).alias("content"))
    container.write_containers(logs, path, files=12)
    assert len([f for f in os.listdir(f"{path}/logs") if f.endswith(".logs")]) <= 12
    back = container.read_containers(spark, path)
    assert back.count() == 20_000 and back.where(F.decode("content", "UTF-8") != F.when(F.col("run_id") % 7 > 0, F.concat(F.lit("log "), F.col("run_id").cast("string"))).otherwise("")).count() == 0
    one = container.read_containers(spark, path, F.col("run_id") == 4711)
    assert [(r.run_id, bytes(r.content)) for r in one.collect()] == [(4711, b"log 4711" if 4711 % 7 else b"")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(run_id), EqualTo(run_id,4711)]" in plan


def test_a_long_run_is_spread(spark):
    events = spark.range(1, 2001).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("seq"), F.lit("LINE").alias("event_type"), F.lit("a b.py").alias("file"), (F.col("id") % 90).cast("int").alias("line"), F.col("id").alias("event_id"), F.lit(None).cast("long").alias("then_id"), F.lit(None).cast("long").alias("else_id"))
    path = scratch_path(spark, "containers")
    container.write_containers(csv_log.text_logs(events, stretch=100), path, files=5)
    assert container.read_index(spark, path).agg(F.count("*"), F.count_distinct("file")).first()[0] == 20 and len(os.listdir(f"{path}/logs")) > 1
    back = csv_log.parse_text_logs(container.read_containers(spark, path), stretch=100)
    assert sorted((r.seq, r.line, r.event_id) for r in back.collect()) == [(n, n % 90, n) for n in range(1, 2001)]


def test_empty_containers(spark):
    path = scratch_path(spark, "containers")
    container.write_containers(spark.createDataFrame([], "run_id long, chunk long, content binary"), path, files=3)
    assert container.read_containers(spark, path).count() == 0


def test_runs_found_by_tasks(spark, tmp_path):
    for name in ("p/b/2", "p/b/deep/er/1", "p/a", "f/x", "p/_SUCCESS"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "p/a" else b"x")
    os.symlink(tmp_path / "p/a", tmp_path / "p/link")
    os.symlink(tmp_path / "p", tmp_path / "p/b/around")
    os.symlink(tmp_path / "f", tmp_path / "p/side")
    os.symlink(tmp_path / "nowhere", tmp_path / "p/broken")
    found = mapping.run_registry(spark, [f"{tmp_path}/p"], [f"{tmp_path}/f/x", f"{tmp_path}/gone"])
    got = [(r.run_id, r.path.removeprefix(f"{tmp_path}/"), r.failing) for r in found.orderBy("run_id").collect()]
    names = ["p/a", "p/b/2", "p/b/deep/er/1", "p/broken", "p/side/x", "f/x", "gone"]
    assert got == [(i, n, i > 4) for i, n in enumerate(names)]


def test_mandatory_fields(spark):
    rnd = random.Random(2)
    columns = [f.split()[0] for f in reports.COUNTS.split(", ")]
    rows = [(kind, f"{kind}:{n}", "f", n, "g" if kind == "DEF_USE" else None, 4 if kind == "DEF_USE" else None, *(float(rnd.randrange(9)) for _ in range(10))) for kind in ("LINE", "DEF_USE", "NONE") for n in range(3)]
    made = spark.createDataFrame(rows, reports.COUNTS)
    path = scratch_path(spark, "typed")
    reports.dump_typed(made, path)
    good, bad = reports.load_typed(spark, path)
    assert sorted(map(tuple, good.select(*columns).collect()), key=str) == sorted(rows, key=str) and bad.count() == 0
    texts = [("LINE", '{"feature": "x"}'), ("DEF_USE", '{"feature":"d","file":"f","line":1,"ef":1,"nf":1,"ep":1,"np":1,"f":2,"p":2}'), ("NONE", '{"feature":"n","file":"f","line":"one","ef":1,"nf":1,"ep":1,"np":1,"f":2,"p":2,"tr":1,"ti":1,"fr":0,"fi":0}'), ("WHAT", "{}"), (None, "{}")]
    rows = reports.checked_rows(spark.createDataFrame(texts, "type string, body string").withColumn("body", F.parse_json("body"))).select("type", "missing").collect()
    assert {r.type: r.missing for r in rows} == {"LINE": ["file", "line", "ef", "nf", "ep", "np", "f", "p"], "DEF_USE": ["file2", "line2"], "NONE": ["line"], "WHAT": ["type"], None: ["type"]}
