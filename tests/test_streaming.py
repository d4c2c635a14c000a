from pyspark.sql import functions as F

from tracesift.operators import sequence
from tracesift.sources import testdata
from tracesift.streaming import live

SF = "/root/testdata/sf0.001"


def test_scopes_as_state(spark, tmp_path):
    events = testdata.trace(spark, SF, "scopes")
    for part in range(3):  # a run's events arrive in order, over several files
        events.where(F.floor((F.col("seq") - 1) / 25) == part).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = live.scopes(files).writeStream.format("memory").queryName("live_scopes").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.run_id, r.seq): (r.depth, r.scope_id) for r in sequence.with_scopes(events.where("seq <= 75")).collect()}
    assert {(r.run_id, r.seq): (r.depth, r.scope_id) for r in spark.table("live_scopes").collect()} == want


def test_hits_and_sessions(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("run_id", F.col("user_id"))
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    query = live.sessions(stream, "2 hours").writeStream.format("memory").outputMode("complete").queryName("live_sessions").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("live_sessions").agg(F.sum("n")).first()[0] == source.count()
