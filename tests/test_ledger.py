import random

from pyspark.sql import functions as F

from tracesift.operators import counts
from tracesift.operators.ledger import Ledger
from tracesift.shared import scratch_path

OBSERVED = "type string, feature string, file string, line int, file2 string, line2 int, run_id long, seq long, truth int"


def observed(spark, rows):
    return spark.createDataFrame([("BRANCH", f"b{n}", "f", n, None, None, run, seq, truth) for run, seq, n, truth in rows], OBSERVED)


def labels(spark, found):
    return spark.createDataFrame(list(found.items()), "run_id long, failing boolean")


def plain(df):
    return sorted((r.feature, r.ef, r.nf, r.ep, r.np, r.f, r.p, r.tr, r.ti, r.fr, r.fi) for r in df.collect())


def test_deliveries_equal_a_recount(spark):
    rnd = random.Random(4)
    rows = [(run, seq, rnd.randrange(6), rnd.randrange(2)) for run in range(30) for seq in range(rnd.randrange(9))]
    first = {run: rnd.random() < 0.5 for run in range(25)}
    ledger = Ledger(spark, scratch_path(spark, "ledger"), 4)
    assert ledger.counts().count() == 0 and ledger.delivered() == -1
    parts = [[r for r in rows if r[0] % 3 == 0 or r[1] % 2], [r for r in rows if r[0] % 3 and not r[1] % 2], rows[:40]]  # runs in pieces; rows that repeat
    changes = [first, {}, {run: rnd.random() < 0.5 for run in range(20, 30)} | {3: not first[3], 4: first[4], 5: None}]
    seen, known = [], {}
    for number, (part, change) in enumerate(zip(parts, changes, strict=True)):
        assert ledger.deliver(number, observed(spark, part), labels(spark, change))
        seen, known = seen + part, known | change
        want = plain(counts.contingency(observed(spark, seen), labels(spark, known).where("failing is not null")))
        assert plain(ledger.counts()) == want
        if number == 1:
            ledger.compact()
            assert plain(ledger.counts()) == want
    assert not ledger.deliver(2, observed(spark, rows), labels(spark, {1: True})) and plain(ledger.counts()) == want
    assert ledger.deliver(7, None, labels(spark, {6: not first[6]})) and ledger.delivered() == 7
    assert plain(ledger.counts()) == plain(counts.contingency(observed(spark, seen), labels(spark, known | {6: not first[6]}).where("failing is not null")))


def test_a_delivery_that_broke_off(spark):
    path = scratch_path(spark, "ledger")
    ledger = Ledger(spark, path, 4)
    ledger.deliver(0, observed(spark, [(1, 1, 1, 1), (2, 1, 1, 0)]), labels(spark, {1: True, 2: False}))
    # Hits and labels of delivery 1 are there, its deltas aren't: it doesn't count, and comes again.
    observed(spark, [(3, 1, 1, 1)]).select(*counts.KEY, "run_id", F.col("truth").alias("hit"), F.lit(0).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/hits/delivery=1")
    labels(spark, {3: True, 1: False}).write.parquet(f"{path}/labels/delivery=1")
    again = Ledger(spark, path, 4)
    assert again.delivered() == 0 and [(r.ef, r.f, r.p) for r in again.counts().collect()] == [(1, 1, 1)]
    assert again.deliver(1, observed(spark, [(3, 1, 1, 1)]), labels(spark, {3: True}))
    assert [(r.ef, r.f, r.p, r.fi) for r in again.counts().collect()] == [(2, 2, 1, 1)]


def test_batches_of_a_stream(spark):
    path = scratch_path(spark, "observed")
    rows = [(run, 1, run % 3, run % 2) for run in range(12)]
    for n in range(3):
        observed(spark, rows[n * 4 : n * 4 + 4]).coalesce(1).write.parquet(f"{path}/{n}")
    ledger, runs = Ledger(spark, scratch_path(spark, "ledger"), 2), labels(spark, {run: run % 4 == 0 for run in range(12)})
    ledger.deliver(0, None, runs)
    stream = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    stream.writeStream.option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).foreachBatch(lambda batch, n: ledger.deliver(n + 1, batch) and None).start().awaitTermination()
    assert ledger.delivered() == 3 and plain(ledger.counts()) == plain(counts.contingency(observed(spark, rows), runs))
