"""Threads: events with a thread_id belong to a thread of the run, those without to its main thread.

A thread starts in the scope in which the main thread is at the thread's first event, its fork point. That scope is the thread's root: what it
defines outside of its own functions it defines there, for the main thread and other threads to see; and it sees what is or gets defined in
that scope and those around it, even after the main thread has left them. Scopes that a thread enters are its own and hide inherited ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequence

VALUES = ("value_num", "value_str", "value_bin", "value_type")


def forks(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """run_id, thread_id, fork_seq, scope_id, scope_depth: for every thread each scope that the main thread is in at its fork point."""
    scoped = events.where(F.col("event_type").isin(*sequence.SCOPE_EVENTS))
    first = scoped.where("thread_id is not null").groupBy(*sequence.RUN).agg(F.min("seq").alias("fork_seq"))
    main = scoped.where("thread_id is null")
    lives = sequence.scope_lifetimes(main, long).where(F.col("scope_id") != sequence.ROOT).select("run_id", "scope_id", "scope_depth", "opened", "closed")
    open_ = sequence.interval_join(first, lives, ["run_id"], "fork_seq", "opened", "closed").select(*sequence.RUN, "fork_seq", "scope_id", "scope_depth")
    return open_.unionByName(first.withColumns({"scope_id": F.lit(sequence.ROOT).cast("long"), "scope_depth": F.lit(0)}))


def with_thread_scopes(events: DataFrame, long: bool | int | None = None, forked: DataFrame | None = None) -> DataFrame:
    """Adds scope_thread, scope_id and depth to scope events: the scope an event is in and the thread that opened it (null: main).
    Depths count from the run's root, through the fork point."""
    long = sequence.is_long(events, long)
    scoped = sequence.with_scopes(events.where(F.col("event_type").isin(*sequence.SCOPE_EVENTS)), long)
    forked = forks(events, long) if forked is None else forked
    inner = forked.groupBy(*sequence.RUN).agg(F.max_by("scope_id", "scope_depth").alias("_fork"), F.max("scope_depth").alias("_base"))
    rows = scoped.join(inner, sequence.RUN, "left")  # events of main have no fork
    rooted = F.col("_fork").isNotNull() & (F.col("depth") == 0)
    return rows.select(
        *events.columns, F.when(~rooted, F.col("thread_id")).alias("scope_thread"), F.when(rooted, F.col("_fork")).otherwise(F.col("scope_id")).alias("scope_id"),
        (F.col("depth") + F.coalesce("_base", F.lit(0))).cast("int").alias("depth"),
    )


def visible_intervals(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """run_id, thread_id, scope_depth, var, start, end and the value's columns: while a thread sees a definition's value. Inherited
    ones are seen from the fork point, or their own event, to the next definition in their scope, or past the run's end."""
    long = sequence.is_long(events, long)
    forked = forks(events, long)
    scoped = with_thread_scopes(events, long, forked)
    owner = ["run_id", "scope_thread", "scope_id"]
    following = F.lead("seq").over(Window.partitionBy(*owner, "var").orderBy("seq"))
    defs = scoped.where("event_type = 'DEF'").select(*owner, "depth", "var", F.col("seq").alias("start"), following.alias("_next"), *VALUES)
    ends = scoped.groupBy("run_id").agg((F.max("seq") + 1).alias("_end"))
    lives = sequence.scope_lifetimes(events.where(F.col("event_type").isin(*sequence.SCOPE_EVENTS)), long).where(F.col("scope_id") != sequence.ROOT)
    lives = lives.select(F.col("run_id").alias("_run"), F.col("thread_id").alias("_thread"), F.col("scope_id").alias("_scope"), "closed")
    same = (F.col("run_id") == F.col("_run")) & F.col("scope_thread").eqNullSafe(F.col("_thread")) & (F.col("scope_id") == F.col("_scope"))
    own = defs.join(lives, same, "left").join(ends, "run_id")
    # A thread may define in a scope of main that is closed already: main doesn't see that.
    own = own.select("run_id", F.col("scope_thread").alias("thread_id"), F.col("depth").alias("scope_depth"), "var", "start", F.coalesce(F.least("_next", "closed"), F.col("_end")).alias("end"), *VALUES).where("start < end")
    of_main = defs.where("scope_thread is null").drop("scope_thread", "depth")
    taken = forked.select("run_id", "thread_id", "fork_seq", "scope_id", "scope_depth")
    inherited = taken.join(of_main, ["run_id", "scope_id"]).join(ends, "run_id")
    inherited = inherited.select("run_id", "thread_id", "scope_depth", "var", F.greatest("start", "fork_seq").alias("start"), F.coalesce("_next", "_end").alias("end"), *VALUES).where("start < end")
    return own.unionByName(inherited)


def visible_variables(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """As sequence.visible_variables(), with what threads inherit: for every DEF each visible variable with its current value."""
    defs = events.where("event_type = 'DEF'").select(*sequence.RUN, "seq", "file", "line", "var", *VALUES)
    known = visible_intervals(events, long).select(*sequence.RUN, F.col("var").alias("other_var"), "scope_depth", "start", "end", *(F.col(c).alias(f"other_{c}") for c in VALUES))
    seen = sequence.interval_join(defs, known, sequence.RUN, "seq", "start", "end")
    inner = F.struct("file", "line", "var", *VALUES, *(f"other_{c}" for c in VALUES))
    best = seen.groupBy(*sequence.RUN, "seq", "other_var").agg(F.max_by(inner, "scope_depth").alias("row"))
    return best.select(*sequence.RUN, "seq", "other_var", "row.*")


def def_use(events: DataFrame, long: bool | int | None = None) -> DataFrame:
    """Every USE with the last DEF before it of its variable: in its scope, else in its thread, else of what the thread inherits, the
    innermost scope first. Adds def_seq to USE events; those without a DEF go."""
    long = sequence.is_long(events, long)
    forked = forks(events, long)
    rows = with_thread_scopes(events, long, forked).where(F.col("event_type").isin("DEF", "USE"))
    seq = F.when(F.col("event_type") == "DEF", F.col("seq"))
    rows = sequence._running(rows, ["run_id", "scope_thread", "scope_id", "var", "var_id"], {"_near": ("last", seq)}, long, before=True)
    rows = sequence._running(rows, [*sequence.RUN, "var", "var_id"], {"_far": ("last", seq)}, long, before=True)
    uses = rows.where("event_type = 'USE'").withColumn("_def", F.coalesce("_near", "_far")).drop("_near", "_far")
    # The last definitions of main's scopes up to a fork point, and those after it while they are current.
    lost = uses.where("_def is null and thread_id is not null").select(*sequence.RUN, "var", "var_id", "seq")
    following = F.lead("seq").over(Window.partitionBy("run_id", "scope_id", "var", "var_id").orderBy("seq"))
    of_main = rows.where("event_type = 'DEF' and scope_thread is null").select("run_id", "scope_id", F.col("var").alias("_var"), F.col("var_id").alias("_var_id"), F.col("seq").alias("_start"), F.coalesce(following, F.lit(2**62)).alias("_next"))
    chances = lost.join(forked, sequence.RUN).join(of_main, ["run_id", "scope_id"]).where(F.col("var").eqNullSafe(F.col("_var")) & F.col("var_id").eqNullSafe(F.col("_var_id")) & (F.col("_start") < F.col("seq")) & (F.col("seq") <= F.col("_next")))
    found = chances.groupBy(*sequence.RUN, "seq").agg(F.max_by("_start", "scope_depth").alias("_inherited"))
    both = uses.join(found, [*sequence.RUN, "seq"], "left").withColumn("def_seq", F.coalesce("_def", "_inherited")).where("def_seq is not null")
    return both.select(*events.columns, "scope_thread", "scope_id", "def_seq")
