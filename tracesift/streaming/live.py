"""Localization over streams of events: counts that grow with the stream, windows, and open scopes as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEPTHS = "run_id long, seq long, depth int, scope_id long"
_STATE = "stack array<long>"


def event_rates(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events per kind and window of time; those later than the watermark are left out. events: ts, event_type."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count("*").alias("n"))


def line_hits(events: DataFrame) -> DataFrame:
    """How often each run hit each line so far. For output mode update or complete."""
    return events.where("event_type = 'LINE'").groupBy("run_id", "file", "line").agg(F.count("*").alias("hits"))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of a run's events without a pause longer than gap."""
    return events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def scopes(events: DataFrame) -> DataFrame:
    """depth and scope_id of every event, with the stack of open scopes as each run's state. A run's events must come in the
    order of seq, from batch to batch; within a batch they are sorted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("seq")
        depths, ids = [], []
        for seq, kind in zip(rows["seq"], rows["event_type"], strict=True):
            if kind == "FUNCTION_ENTER":
                stack.append(int(seq))
            depths.append(len(stack))
            ids.append(stack[-1] if stack else 0)
            if kind in ("FUNCTION_EXIT", "FUNCTION_ERROR") and stack:
                stack.pop()
        state.update((stack,))
        yield pd.DataFrame({"run_id": key[0], "seq": rows["seq"], "depth": depths, "scope_id": ids})

    return events.select("run_id", "seq", "event_type").groupBy("run_id").applyInPandasWithState(step, DEPTHS, _STATE, "append", GroupStateTimeout.NoTimeout)
