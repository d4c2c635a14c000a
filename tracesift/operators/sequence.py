"""Sequence operators: what a run's order of events implies.

Running values are windows over (run, thread), or, where a run is too long for one task, prefix scans over its stretches (scan.py);
``long`` says which, or gives the stretches' width, and is found by counting unless given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

RUN = ["run_id", "thread_id"]
ROOT = 0
SCOPE_EVENTS = ("DEF", "USE", "FUNCTION_ENTER", "FUNCTION_EXIT", "FUNCTION_ERROR")


def _run_window(*keys: str) -> Window:
    return Window.partitionBy(*RUN, *keys).orderBy("seq")


def _running(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], long: bool | int, before: bool = False) -> DataFrame:
    return scan.running(df, keys, "seq", ["seq"], values, before=before, long=long)


def is_long(events: DataFrame, long: bool | int | None, *keys: str) -> bool | int:
    return scan.has_long(events, list(keys) or ["run_id"]) if long is None else long


def with_scopes(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """Adds depth and scope_id (the seq of the FUNCTION_ENTER that opened the scope, ROOT outside of functions).

    An enter opens its scope before the event is handled; an exit or error closes it after. Exits at the root do
    nothing: the running sum is corrected by its least value so far.
    """
    long = is_long(events, long)
    step = F.when(F.col("event_type") == "FUNCTION_ENTER", 1).when(F.col("event_type").isin("FUNCTION_EXIT", "FUNCTION_ERROR"), -1).otherwise(0)
    df = _running(events, RUN, {"_cum": ("sum", step)}, long)
    df = _running(df, RUN, {"_low": ("min", F.col("_cum"))}, long)
    df = df.withColumn("_after", F.col("_cum") - F.least(F.lit(0), F.col("_low")))
    df = _running(df, RUN, {"_before": ("last", F.col("_after"))}, long, before=True)
    closing = F.col("event_type").isin("FUNCTION_EXIT", "FUNCTION_ERROR")
    df = df.withColumn("depth", F.when(closing, F.coalesce("_before", F.lit(0))).otherwise(F.col("_after")).cast("int"))
    df = _running(df, [*RUN, "depth"], {"_opened": ("last", F.when(F.col("event_type") == "FUNCTION_ENTER", F.col("seq")))}, long)
    return df.withColumn("scope_id", F.when(F.col("depth") == 0, F.lit(ROOT)).otherwise(F.col("_opened")).cast("long")).drop("_cum", "_low", "_after", "_before", "_opened")


def def_use(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """An as-of join: every USE with the last DEF before it of its variable in the same scope, else in the run.

    Adds def_seq, def_file and def_line to USE events; those without a DEF go.
    """
    long = is_long(events, long)
    rows = with_scopes(events.where(F.col("event_type").isin(*SCOPE_EVENTS)), long).where(F.col("event_type").isin("DEF", "USE"))
    place = F.when(F.col("event_type") == "DEF", F.struct(F.col("seq").alias("def_seq"), F.col("file").alias("def_file"), F.col("line").alias("def_line")))
    rows = _running(rows, [*RUN, "var", "var_id", "scope_id"], {"_near": ("last", place)}, long, before=True)
    rows = _running(rows, [*RUN, "var", "var_id"], {"_far": ("last", place)}, long, before=True)
    found = rows.withColumn("_def", F.coalesce("_near", "_far")).where((F.col("event_type") == "USE") & F.col("_def").isNotNull())
    return found.select(*events.columns, "scope_id", "_def.*")


def loop_counts(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """run_id, thread_id, file, line, loop_id, seq, iterations: a row for every LOOP_END.

    A loop's events form a stack: BEGIN pushes a count of 0, HIT adds one to the top (or pushes 1), END pops (0 if empty).
    Running sums give the depth at each event, a HIT or END of an empty stack being one of depth 0 before it; the frame an event
    belongs to begins at the last push of its depth; and its hits are counted in a running sum over the frames of that depth.
    """
    keys = [*RUN, "file", "line", "loop_id"]
    rows = events.where(F.col("event_type").isin("LOOP_BEGIN", "LOOP_HIT", "LOOP_END")).select(*keys, "seq", F.col("event_type").alias("kind"))
    long = is_long(rows, long, *keys)
    begin, hit, end = (F.col("kind") == f"LOOP_{k}" for k in ("BEGIN", "HIT", "END"))
    # How deep the stack would be if a HIT never pushed: BEGIN and END alone, ENDs of an empty stack left out.
    rows = _running(rows, keys, {"sum": ("sum", F.when(begin, 1).when(end, -1).otherwise(0))}, long)
    rows = _running(rows, keys, {"low": ("min", F.col("sum"))}, long)
    rows = rows.withColumn("depth", (F.col("sum") - F.least(F.lit(0), F.col("low"))).cast("int"))
    rows = _running(rows, keys, {"last": ("last", F.col("depth"))}, long, before=True).withColumn("before", F.coalesce("last", F.lit(0)))
    # HITs at depth 0 push a frame under all later ones, which lasts until an END at depth 0. The number of such ENDs before names it.
    floor = F.when(end & (F.col("before") == 0), 1).otherwise(0)
    rows = _running(rows, keys, {"floors": ("sum", floor)}, long).withColumn("floor", F.col("floors") - floor)
    # The depth of the frame that a HIT counts in or an END pops: that before the event; a BEGIN opens the depth after it.
    rows = rows.withColumn("frame_depth", F.when(begin, F.col("depth")).otherwise(F.col("before")))
    rows = _running(rows, [*keys, "frame_depth"], {"pushed": ("last", F.when(begin, F.col("seq")))}, long)
    rows = rows.withColumn("opened", F.when(F.col("frame_depth") == 0, -F.col("floor") - 1).otherwise(F.col("pushed")))
    rows = _running(rows, [*keys, "frame_depth", "opened"], {"hits": ("sum", F.when(hit, 1).otherwise(0))}, long)
    return rows.where("kind = 'LOOP_END'").select(*keys, "seq", F.col("hits").cast("long").alias("iterations"))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int = 256) -> DataFrame:
    """Points with the intervals (start included, end not) that hold them, equal keys (null-safe) given.

    Intervals are repeated for every stretch of so many places that they touch, so that the join is by key and stretch
    and a long run spreads over many groups. Columns of intervals other than the keys must have names of their own.
    """
    left = points.withColumn("_stretch", F.floor(F.col(point) / width))
    right = intervals.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in intervals.columns if c not in keys), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("_r_stretch"))
    on = F.col("_stretch") == F.col("_r_stretch")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(right, on & (F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))
    return joined.drop("_stretch", "_r_stretch", *(f"_r_{k}" for k in keys))


def scope_lifetimes(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """run_id, thread_id, scope_id, scope_depth, opened, closed: from a scope's ENTER to its exit, or past the run's end. With the root."""
    scoped = with_scopes(events, long)
    closing = F.col("event_type").isin("FUNCTION_EXIT", "FUNCTION_ERROR") & (F.col("depth") > 0)
    ends = scoped.groupBy(*RUN, "scope_id").agg(F.min("depth").alias("scope_depth"), F.min("seq").alias("opened"), F.min(F.when(closing, F.col("seq"))).alias("_closed"), F.max("seq").alias("_last_own"))
    last = scoped.groupBy(F.col("run_id").alias("_run"), F.col("thread_id").alias("_thread")).agg(F.max("seq").alias("_last"), F.min("seq").alias("_first"))
    both = ends.join(last, (F.col("run_id") == F.col("_run")) & F.col("thread_id").eqNullSafe(F.col("_thread")))
    known = both.where(F.col("scope_id") != ROOT).select(*RUN, "scope_id", "scope_depth", "opened", F.coalesce("_closed", F.col("_last") + 1).alias("closed"))
    roots = last.select(F.col("_run").alias("run_id"), F.col("_thread").alias("thread_id"), F.lit(ROOT).cast("long").alias("scope_id"), F.lit(0).alias("scope_depth"), F.col("_first").alias("opened"), (F.col("_last") + 1).alias("closed"))
    return known.unionByName(roots)


def scope_ancestors(events: DataFrame) -> DataFrame:
    """run_id, thread_id, scope_id, ancestor_id, distance: every scope with all scopes around it, itself at 0."""
    lives = scope_lifetimes(events)
    around = lives.select(*RUN, F.col("scope_id").alias("ancestor_id"), F.col("scope_depth").alias("ancestor_depth"), F.col("opened").alias("from"), F.col("closed").alias("to"))
    found = interval_join(lives, around, RUN, "opened", "from", "to").where((F.col("ancestor_depth") < F.col("scope_depth")) | (F.col("ancestor_id") == F.col("scope_id")))
    return found.select(*RUN, "scope_id", "ancestor_id", (F.col("scope_depth") - F.col("ancestor_depth")).alias("distance"))


def variable_intervals(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """run_id, thread_id, scope_id, scope_depth, var, start, end and the value's columns: while a DEF's value is current, from
    its own event to the next DEF of the variable in its scope, or the end of the scope."""
    long = is_long(events, long)
    scoped = with_scopes(events, long).where("event_type = 'DEF'")
    following = F.lead("seq").over(_run_window("scope_id", "var"))
    defs = scoped.select(*RUN, "scope_id", "var", F.col("seq").alias("start"), following.alias("_next"), "value_num", "value_str", "value_bin", "value_type")
    lives = scope_lifetimes(events, long).select(F.col("run_id").alias("_run"), F.col("thread_id").alias("_thread"), F.col("scope_id").alias("_scope"), "scope_depth", "closed")
    joined = defs.join(lives, (F.col("run_id") == F.col("_run")) & F.col("thread_id").eqNullSafe(F.col("_thread")) & (F.col("scope_id") == F.col("_scope")))
    return joined.select(*RUN, "scope_id", "scope_depth", "var", "start", F.coalesce("_next", "closed").alias("end"), "value_num", "value_str", "value_bin", "value_type")


def visible_variables(events: DataFrame) -> DataFrame:
    """For every DEF each variable visible from its scope, with its current value: the DEF's columns, then other_var and the
    value's columns with the prefix other_. Inner scopes hide outer ones; the defined variable sees itself."""
    defs = events.where("event_type = 'DEF'").select(*RUN, "seq", "file", "line", "var", "value_num", "value_str", "value_bin", "value_type")
    known = variable_intervals(events)
    values = ("value_num", "value_str", "value_bin", "value_type")
    known = known.select(*RUN, F.col("var").alias("other_var"), "scope_depth", "start", "end", *(F.col(c).alias(f"other_{c}") for c in values))
    seen = interval_join(defs, known, RUN, "seq", "start", "end")
    inner = F.struct("file", "line", "var", *values, *(f"other_{c}" for c in values))
    best = seen.groupBy(*RUN, "seq", "other_var").agg(F.max_by(inner, "scope_depth").alias("row"))
    return best.select(*RUN, "seq", "other_var", "row.*")


def segments(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """Adds segment and cut: a run is cut where a test event's place differs from the last one's, and at every TEST_END after another
    test event. What precedes the first test event belongs to the first segment. Threads of a run share its segments."""
    long = is_long(events, long)
    test = F.coalesce(F.col("event_type").startswith("TEST_"), F.lit(False))
    place = F.when(test, F.struct("file", "line"))
    rows = _running(events, ["run_id"], {"_last": ("last", place)}, long, before=True)
    rows = rows.withColumn("cut", test & F.col("_last").isNotNull() & ((F.col("event_type") == "TEST_END") | ~place.eqNullSafe(F.col("_last")))).drop("_last")
    return _running(rows, ["run_id"], {"segment": ("sum", F.col("cut").cast("int"))}, long).withColumn("segment", F.col("segment").cast("int"))
