"""From observations to contingency counts of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..schema import PREDICATES

KEY = ["type", "feature", "file", "line", "file2", "line2"]


def run_hits(observations: DataFrame) -> DataFrame:
    """A row per feature and run that observed it: hit, how often, and the last truth. Partly aggregated before the shuffle."""
    return observations.groupBy(*KEY, "run_id").agg(F.max("truth").alias("hit"), F.sum("truth").alias("hits"), F.count("*").alias("seen"), F.max_by("truth", "seq").alias("last"))


def thread_hits(observations: DataFrame, events: DataFrame) -> DataFrame:
    """As run_hits(), by thread of the run: each thread's hits and its last evaluation are its own."""
    placed = observations.join(events.select("run_id", "seq", "thread_id"), ["run_id", "seq"])
    return placed.groupBy(*KEY, "run_id", "thread_id").agg(F.max("truth").alias("hit"), F.sum("truth").alias("hits"), F.count("*").alias("seen"), F.max_by("truth", "seq").alias("last"))


def totals(runs: DataFrame) -> DataFrame:
    """One row: failing and passing runs of the registry, with events or without."""
    return runs.agg(F.count_if("failing").cast("double").alias("f"), F.count_if(~F.col("failing")).cast("double").alias("p"))


def contingency(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per feature: ef, nf, ep, np, f, p; and of the runs that observed it tr, ti (true, failing and passing) and fr, fi (false)."""
    labelled = run_hits(observations).join(runs.select("run_id", "failing"), "run_id")
    count = lambda test: F.count_if(test).cast("double")
    hit, failing = F.col("hit") == 1, F.col("failing")
    per = labelled.groupBy(*KEY).agg(
        count(failing & hit).alias("ef"), count(~failing & hit).alias("ep"), count(failing & ~hit).alias("fr"), count(~failing & ~hit).alias("fi")
    )
    both = per.crossJoin(F.broadcast(totals(runs)))  # one row
    return both.select(*KEY, "ef", (F.col("f") - F.col("ef")).alias("nf"), "ep", (F.col("p") - F.col("ep")).alias("np"), "f", "p", F.col("ef").alias("tr"), F.col("ep").alias("ti"), "fr", "fi")


def scored(counts: DataFrame, *names: str) -> DataFrame:
    """Adds a column for each metric; the default is Ochiai for spectra and IncreaseTrue for predicates, as score."""
    if not names:
        default = F.when(F.col("type").isin(*PREDICATES), metrics.metric("IncreaseTrue")).otherwise(metrics.metric("Ochiai"))
        return counts.withColumn("score", default)
    return counts.select("*", *(metrics.metric(n).alias(n) for n in names))


def scored_long(counts: DataFrame, *names: str) -> DataFrame:
    """A row per feature and metric: metric, score."""
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), metrics.metric(n).alias("score")) for n in names))
    return counts.select(*counts.columns, F.explode(pairs).alias("_m")).select(*counts.columns, "_m.metric", "_m.score")


def coverage(observations: DataFrame) -> DataFrame:
    """run_id and its number of features, observed in whatever way."""
    return observations.select("run_id", "type", "feature").distinct().groupBy("run_id").agg(F.count("*").alias("n_features"))


def covered_places(observations: DataFrame) -> DataFrame:
    """The union of all runs' coverage."""
    return observations.select("type", "feature", "file", "line").distinct()


def weighted(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds weight: a feature's mean over the runs that have one for it; 0 without any. weights: type, feature, run_id, weight."""
    per_run = weights.groupBy("type", "feature", "run_id").agg(F.max("weight").alias("weight"))
    mean = per_run.groupBy("type", "feature").agg(F.avg("weight").alias("weight"))
    return counts.join(mean, ["type", "feature"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
