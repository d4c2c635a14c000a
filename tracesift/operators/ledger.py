"""Counts that are kept up to date: deliveries of observations and of labels, each counted alone and added to what is stored.

A ledger is a folder with four tables. hits: what is known of a feature in a run, rows of later deliveries above earlier ones. labels: outcomes
of runs, of which the last delivered holds. deltas: what each delivery changes in the counts of a feature, and in the totals of runs (type is null).
bases: sums of all deltas down to a delivery. Counts are the sum of a base and the deltas after it.

A delivery may bring runs, further pieces of runs, runs that have no outcome yet, and outcomes that are new or differ from those before. A run's
hits move between the cells then: what changes is the run's contribution now less its contribution before, so a delivery that repeats rows changes
nothing. Deliveries have growing numbers, as the batches of a stream have. One that broke off is delivered again under its number: it reads
earlier ones only, overwrites its own tables, and counts once its deltas are written, which it does last.

Hits are dealt to buckets of runs; a delivery reads the buckets of its own runs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from .counts import KEY, run_hits

#: Folders that hits are dealt to; a ledger keeps the number that it began with.
BUCKETS = 64
_KEYS = "type string, feature string, file string, line int, file2 string, line2 int"
_CELLS = ("tr", "ti", "fr", "fi")
_SCHEMAS = {
    "hits": f"{_KEYS}, run_id long, hit int, bucket int, delivery long",
    "labels": "run_id long, failing boolean, delivery long",
    "deltas": f"{_KEYS}, {', '.join(f'{c} long' for c in _CELLS)}, delivery long",
    "bases": f"{_KEYS}, {', '.join(f'{c} long' for c in _CELLS)}, delivery long",
}


class Ledger:
    """A ledger in a folder of a store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        for name in _SCHEMAS:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, number: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/delivery={number}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("run_id"), F.lit(self.buckets)).cast("int")

    def delivered(self) -> int:
        """The number of the last whole delivery; -1 before the first."""
        last = self._read("deltas").select(F.max("delivery")).first()[0]
        return max(-1 if last is None else last, self._base())

    def _base(self) -> int:
        found = self._read("bases").select(F.max("delivery")).first()[0]
        return -1 if found is None else found

    def deliver(self, number: int, observations: DataFrame | None = None, runs: DataFrame | None = None) -> bool:
        """Adds observations and outcomes (run_id, failing; null: taken back). False if the number was delivered before."""
        if number <= self.delivered():
            return False
        made = run_hits(observations).select(*KEY, "run_id", "hit") if observations is not None else self._read("hits").select(*KEY, "run_id", "hit").limit(0)
        made = stored(made, "delivered-hits")
        labels = (runs.groupBy("run_id").agg(F.max("failing").alias("failing")) if runs is not None else self._read("labels").select("run_id", "failing").limit(0))
        labels = stored(labels.withColumn("named", F.lit(True)), "delivered-labels")
        before = self._read("labels").where(F.col("delivery") < number).groupBy("run_id").agg(F.max_by("failing", "delivery").alias("old_failing"))
        concerned = made.select("run_id").distinct().join(labels, "run_id", "full").join(before, "run_id", "left")
        concerned = stored(concerned.select("run_id", self._bucket().alias("bucket"), "old_failing", F.when(F.col("named"), F.col("failing")).otherwise(F.col("old_failing")).alias("failing")), "delivered-runs")
        touched = [r.bucket for r in concerned.select("bucket").distinct().collect()]  # numbers of folders
        past = self._read("hits").where((F.col("delivery") < number) & F.col("bucket").isin(touched)).join(concerned.select("run_id"), "run_id", "left_semi")
        both = past.select(*KEY, "run_id", F.col("hit").alias("old"), F.lit(None).cast("int").alias("new")).unionByName(made.select(*KEY, "run_id", F.lit(None).cast("int").alias("old"), F.col("hit").cast("int").alias("new")))
        state = both.groupBy(*KEY, "run_id").agg(F.max("old").alias("old"), F.max("new").alias("new")).withColumn("now", F.greatest("old", "new"))
        state = stored(state.join(concerned, "run_id"), "delivered-state")
        self._write(state.where("old is null or now > old").select(*KEY, "run_id", F.col("now").alias("hit"), "bucket"), "hits", number, "bucket")
        self._write(labels.select("run_id", "failing"), "labels", number)
        cell = lambda hit, failing, wants, fails: F.coalesce((hit == wants) & (failing == F.lit(fails)), F.lit(False)).cast("long")
        old, now = (F.col("old"), F.col("old_failing")), (F.col("now"), F.col("failing"))
        kinds = ((1, True), (1, False), (0, True), (0, False))
        cells = state.groupBy(*KEY).agg(*(F.sum(cell(*now, *k) - cell(*old, *k)).alias(c) for c, k in zip(_CELLS, kinds, strict=True)))
        is_ = lambda c, fails: F.coalesce(F.col(c) == F.lit(fails), F.lit(False)).cast("long")
        sums = concerned.agg(*(F.coalesce(F.sum(is_("failing", x) - is_("old_failing", x)), F.lit(0)).alias(c) for c, x in (("tr", True), ("ti", False))))
        totals = sums.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields if f.name in KEY), "tr", "ti", F.lit(0).cast("long").alias("fr"), F.lit(0).cast("long").alias("fi"))
        changed = cells.where(F.greatest(*(F.abs(c) for c in _CELLS)) > 0)
        self._write(changed.unionByName(totals), "deltas", number)
        return True

    def _sums(self) -> DataFrame:
        base = self._base()
        rows = self._read("bases").where(F.col("delivery") == base).unionByName(self._read("deltas").where(F.col("delivery") > base))
        return rows.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in _CELLS))

    def compact(self) -> None:
        """Sums all deltas into a base, which holds once it is written; what went before stays for readers at work, until vacuum()."""
        last = self.delivered()
        if last > self._base():
            self._write(self._sums().where("type is null or greatest(abs(tr), abs(ti), abs(fr), abs(fi)) > 0"), "bases", last)

    def counts(self) -> DataFrame:
        """As counts.contingency() of all that was delivered. Features of runs without an outcome only are left out."""
        sums = self._sums()
        totals = sums.where("type is null").select(F.col("tr").cast("double").alias("f"), F.col("ti").cast("double").alias("p"))
        known = sums.where("type is not null and tr + ti + fr + fi > 0").select(*KEY, *(F.col(c).cast("double").alias(c) for c in _CELLS))
        both = known.crossJoin(F.broadcast(totals))  # one row
        return both.select(*KEY, F.col("tr").alias("ef"), (F.col("f") - F.col("tr")).alias("nf"), F.col("ti").alias("ep"), (F.col("p") - F.col("ti")).alias("np"), "f", "p", "tr", "ti", "fr", "fi")
