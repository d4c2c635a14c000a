"""Test-proximity weights: how near a feature's segment is to the end of a failing test.

A test's segments are those of sequence.segments(). Those before the first TEST_START and from the last TEST_END on (fixtures)
weigh half; without a TEST_END only the former do. Distances then lessen the weight in equal steps. Runs without test
events have no weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence


def segment_features(events: DataFrame, observations: DataFrame) -> DataFrame:
    """type, feature, run_id, segment: in which segments of a run a feature was observed."""
    placed = sequence.segments(events).select("run_id", "seq", "segment")
    return observations.join(placed, ["run_id", "seq"]).select("type", "feature", "run_id", "segment").distinct()


def _parts(events: DataFrame) -> DataFrame:
    """run_id, segment, place of its test events, last, closest, base: a row for each segment of runs with test events.

    closest is the segment that the last TEST_END after another test event cut off; base is 1 inside of the test's function.
    """
    rows = sequence.segments(events)
    kind, test = F.col("event_type"), F.col("event_type").startswith("TEST_")
    start, end = F.when(kind == "TEST_START", F.col("seq")), F.when(kind == "TEST_END", F.col("seq"))
    marks = rows.groupBy("run_id").agg(
        F.max("segment").alias("last"), F.count_if(test).alias("tests"),
        F.min(start).alias("start_seq"), F.min(F.when(kind == "TEST_START", F.col("segment"))).alias("start"),
        F.max(end).alias("end_seq"), F.max(F.when(kind == "TEST_END", F.col("segment"))).alias("end"),
        F.max(F.when((kind == "TEST_END") & F.col("cut"), F.col("segment") - 1)).alias("closest"),
    ).where("tests > 0")
    parts = rows.groupBy("run_id", "segment").agg(F.max(F.when(test, F.struct("file", "line"))).alias("place"))  # all its test events share it
    segment = F.col("segment")
    first = F.when(F.col("start_seq") < F.col("end_seq"), F.col("start")).otherwise(0)  # a start after the last end opens nothing
    inside = F.when(F.col("end").isNotNull(), (segment >= first) & (segment < F.col("end"))).otherwise(segment >= F.coalesce("start", F.lit(0)))
    return parts.join(marks, "run_id").select("run_id", "segment", "place", "last", "closest", F.when(inside, 1.0).otherwise(0.5).alias("base"))


def function_weights(events: DataFrame) -> DataFrame:
    """run_id, segment, weight: 1 inside of a test's function, a half before its start or after its end."""
    return _parts(events).select("run_id", "segment", F.col("base").alias("weight"))


def line_weights(events: DataFrame) -> DataFrame:
    """run_id, segment, distance, weight. Distances grow backwards from the segment before the one that the test's end cut off, at 0, and
    forwards from that one, at 1; without a test's end, backwards from the last."""
    segment, closest = F.col("segment"), F.col("closest")
    distance = F.when(closest.isNull(), F.col("last") - segment).when(segment < closest, closest - 1 - segment).otherwise(segment - closest + 1)
    found = _parts(events).withColumn("distance", distance)
    farthest = found.groupBy("run_id").agg((F.max("distance") + 1).alias("steps"))
    return found.join(farthest, "run_id").select("run_id", "segment", "distance", (F.col("base") * (1 - F.col("distance") / F.col("steps"))).alias("weight"))


def sources(events: DataFrame, uses: bool = False) -> DataFrame:
    """run_id, segment, seq, source: for every TEST_USE the segment that defined its variable, its own or the last before;
    with uses, a segment that used a known variable becomes what later ones go back to."""
    rows = sequence.segments(events).where(F.col("event_type").isin("TEST_DEF", "TEST_USE"))
    name = ["run_id", "var", "var_id"]
    touched = rows.groupBy(*name, "segment").agg(F.bool_or(F.col("event_type") == "TEST_DEF").alias("defines"))
    order = Window.partitionBy(*name).orderBy("segment")
    known = F.max("defines").over(order.rowsBetween(Window.unboundedPreceding, 0))
    touched = touched.withColumn("known", known)
    leads = F.col("known") if uses else F.col("defines")
    before = F.last(F.when(leads, F.col("segment")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    touched = touched.withColumn("source", F.when(F.col("defines"), F.col("segment")).otherwise(before)).where("source is not null")
    used = rows.where("event_type = 'TEST_USE'").select(*(F.col(c).alias(f"_{c}") for c in [*name, "segment", "seq"]))
    same = F.lit(True)
    for c in [*name, "segment"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return used.join(touched, same).select("run_id", "segment", F.col("_seq").alias("seq"), "source")


def _shortened(parts: Column) -> Column:
    """The distances of a run's segments, in order, once each segment has brought those it leads back to within one step, nearest first.
    Later segments come first, and lead back only, so a segment's own distance is final when its turn comes."""

    def visit(d: Column, part: Column) -> Column:
        nearer = lambda x, i: F.when(F.array_contains(part["back"], i), F.least(x, F.get(d, part["segment"]) + 1)).otherwise(x)
        return F.when(F.size(part["back"]) > 0, F.transform(d, nearer)).otherwise(d)

    return F.aggregate(F.reverse(parts), F.transform(parts, lambda p: p["distance"]), visit)


def _asserted(parts: Column, shortened: Column) -> Column:
    """The distances after a second visit, nearest first by the shortened ones, ties by segment."""
    order = F.array_sort(F.transform(parts, lambda p: F.struct(F.get(shortened, p["segment"]).alias("d"), p["segment"].alias("segment"), p["asserts"].alias("asserts"), p["back"].alias("back"))))
    put = lambda a, at, value: F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))
    state = lambda d, costly: F.struct(d.alias("d"), costly.alias("costly"))

    def visit(s: Column, part: Column) -> Column:
        at = part["segment"]
        hit = part["asserts"] & (F.get(s["d"], at) > 0)
        first = F.when(hit, state(put(s["d"], at, F.get(s["d"], at) + 1), put(s["costly"], at, F.lit(True)))).otherwise(s)

        def lead(t: Column, origin: Column) -> Column:
            costly = F.get(t["costly"], at)
            near = F.least(F.get(t["d"], origin), F.get(t["d"], at) + 1) + costly.cast("int")
            return state(put(t["d"], origin, near), put(t["costly"], origin, F.get(t["costly"], origin) | costly))

        return F.aggregate(part["back"], first, lead)

    return F.aggregate(order, state(shortened, F.transform(parts, lambda p: F.lit(False))), visit)["d"]


def def_use_weights(events: DataFrame, uses: bool = False, asserts: bool = False) -> DataFrame:
    """run_id, segment, distance, weight: distances from the last segment, shortened along definitions and uses of test variables.

    Segments are visited once, nearest first, and bring those they lead back to within one step. With asserts, a second
    visit makes each segment at the place of a TEST_ASSERT, but those at distance 0, one farther, and what it leads back to.
    The order of visits matters, so a run's segments, with their sources, are folded in order, over an array of distances.
    """
    parts = _parts(events)
    back = sources(events, uses).groupBy("run_id", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", "source"))).alias("back"))
    asserting = events.where("event_type = 'TEST_ASSERT'").select("run_id", F.struct("file", "line").alias("place"), F.lit(True).alias("asserts")).distinct()
    every = parts.join(back, ["run_id", "segment"], "left").join(asserting, ["run_id", "place"], "left")
    origins = F.coalesce(F.transform("back", lambda b: b["source"].cast("int")), F.array().cast("array<int>"))
    part = F.struct(F.col("segment").cast("int").alias("segment"), (F.col("last") - F.col("segment")).cast("int").alias("distance"), "base", F.coalesce("asserts", F.lit(False)).alias("asserts"), origins.alias("back"))
    # A row per run: as many entries as its test has segments. Each step is a column of its own, as lambdas would compute it anew.
    folded = every.groupBy("run_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("short", _shortened(F.col("parts")))
    folded = folded.withColumn("d", F.get(F.transform(F.array("short"), lambda s: _asserted(F.col("parts"), s)), F.lit(0)) if asserts else F.col("short"))
    rows = folded.select("run_id", F.array_max("d").alias("most"), F.explode(F.zip_with("parts", "d", lambda p, d: F.struct(p["segment"].alias("segment"), p["base"].alias("base"), d.alias("distance")))).alias("p"))
    return rows.select("run_id", "p.segment", "p.distance", (F.col("p.base") * (1 - F.col("p.distance") / (F.col("most") + 1))).alias("weight"))


def feature_weights(features: DataFrame, segment_weights: DataFrame, runs: DataFrame) -> DataFrame:
    """type, feature, run_id, weight in failing runs: the greatest of the segments that observed the feature."""
    failing = runs.where("failing").select("run_id")
    joined = features.join(failing, "run_id", "left_semi").join(segment_weights.select("run_id", "segment", "weight"), ["run_id", "segment"])
    return joined.groupBy("type", "feature", "run_id").agg(F.max("weight").alias("weight"))
