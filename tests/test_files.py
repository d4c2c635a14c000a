import os

import pyarrow as pa
from pyspark.sql import functions as F

from tracesift.plans import localization
from tracesift.shared import shared_dir
from tracesift.sources import csv_log, files, mapping, reports


def events(spark, runs, each):
    made = spark.range(runs * each).select((F.col("id") % runs).alias("run_id"), (F.floor(F.col("id") / runs) + 1).alias("seq"))
    none = F.lit(None).cast("long")
    return made.select("run_id", "seq", F.lit("LINE").alias("event_type"), F.lit("a b.py").alias("file"), F.col("seq").cast("int").alias("line"), (F.col("run_id") * 1000 + F.col("seq")).alias("event_id"), none.alias("then_id"), none.alias("else_id"))


def test_a_file_per_run(spark, tmp_path):
    path = f"{tmp_path}/logs"
    csv_log.write_csv_logs(events(spark, 300, 7), path)
    assert sorted(os.listdir(path)) == sorted(f"run_id={n}.csv" for n in range(300))  # no folder, checksum or mark beside them
    assert open(f"{path}/run_id=12.csv").read() == "".join(f"0,a b.py,{n},{12000 + n}\n" for n in range(1, 8))
    back = csv_log.read_csv_logs(spark, path, F.regexp_extract(F.col("_metadata.file_path"), r"run_id=(\d+)", 1).cast("long"))
    assert sorted((r.run_id, r.seq, r.event_id) for r in back.collect()) == [(run, n, run * 1000 + n) for run in range(300) for n in range(1, 8)]
    assert back.where(~F.col("log").startswith("file:///")).count() == 0


def test_runs_of_flat_folders(spark, tmp_path):
    for name in ("good", "bad"):
        csv_log.write_csv_logs(events(spark, 25, 1).where("run_id % 2 = " + str(int(name == "bad"))), f"{tmp_path}/{name}")
    csv_log.write_csv_logs(events(spark, 1, 1).where("false"), f"{tmp_path}/none")
    found = mapping.run_registry(spark, [f"{tmp_path}/good", f"{tmp_path}/none"], f"{tmp_path}/bad")
    names = [sorted(f"run_id={n}.csv" for n in range(25) if n % 2 == odd) for odd in (0, 1)]
    assert [(r.run_id, os.path.basename(r.path), r.failing) for r in found.orderBy("run_id").collect()] == [(i, n, i >= 13) for i, n in enumerate(names[0] + names[1])]


def test_many_folders_are_few_batches(tmp_path):
    import pandas as pd

    for n in range(500):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "log").write_bytes(b"x")
    frames = list(files._visit(iter([pd.DataFrame({"path": [f"{tmp_path}/{n}" for n in range(500)], "failing": False})])))
    assert len(frames) == 1 and len(frames[0]) == 500 and set(frames[0]["kind"]) == {"file"}


def test_lines_of_pieces(tmp_path):
    for data in (b"", b"a", b"\n", b"a\r\nbb\r\n\r\nccc\rd\n\ne", b"\r\n\r\n", b"ab\ncd\n", b"x" * 9 + b"\r\n" + b"y" * 9, b"\xef\xbb\xbfa\nb"):
        path = str(tmp_path / "log")
        open(path, "wb").write(data)
        for step in range(1, len(data) + 2):
            got = [x for at in range(0, len(data), step) for x in files.lines_of(path, at, min(step, len(data) - at))]
            assert got == data.removeprefix(b"\xef\xbb\xbf").splitlines(), (data, step)


def test_large_file_in_pieces(spark, tmp_path):
    with open(tmp_path / "log", "w") as file:
        file.writelines(f"0,main.py,{n},{n},{'x' * 50}\n" for n in range(400_000))
    assert os.path.getsize(tmp_path / "log") > files.PIECE_BYTES
    (tmp_path / "small").write_text("0,b.py,1,1\r\nbad\r\n0,b.py,1,1")
    got = csv_log.read_csv_logs(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("seq") - F.col("event_id")).alias("d")).collect()
    assert sorted(map(tuple, got)) == [("b.py", 1, 0), ("main.py", 400_000, 400_000)]


def test_ranges_come_in_bounded_batches():
    text = "\n".join(["if a:", "    b = 1", "else:", "    b = 2"] * 50)
    texts = pa.RecordBatch.from_arrays([pa.array([f"f{n}" for n in range(500)]), pa.array([text] * 499 + ["def ("])], names=["file", "text"])
    sizes = [b.num_rows for b in reports._range_batches(iter([texts, texts.slice(0, 0)]))]
    assert sum(sizes) == 499 * 150 and max(sizes) <= reports.RANGE_ROWS


def test_a_file_per_user(spark, tmp_path):
    kinds = ("click", "view", "purchase", "signup", "error")
    rows = [(n, n % 40, kinds[n % 5 if n % 40 else 0], 1.0) for n in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    there = lambda: {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("junit-")}
    before = there()
    got = localization.QUERIES["junit_files"](spark, str(tmp_path)).collect()
    want = [(f"u{u}::t{e}", "FAILED" if k in ("signup", "error") else "PASSED") for e, u, k, _ in rows if k != "purchase"]
    assert sorted(map(tuple, got)) == sorted(want)
    (made,) = there() - before
    assert sorted(os.listdir(f"{shared_dir(spark).removeprefix('file://')}/{made}")) == sorted(f"user_id={n}.xml" for n in range(40))
