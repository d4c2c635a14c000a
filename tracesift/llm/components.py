"""Connected components by repeated contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Rows of a small table that one task handles; without it every round would deal a few rows to as many tasks as the session shuffles to.
TASK_ROWS = 100_000


def tasks_for(rows: int, each: int = TASK_ROWS) -> int:
    return 1 + rows // each


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); nodes of a component share a root, itself a node.

    In each round every node joins its neighbour of least hash, or itself if that is less, and the edges
    shrink to those between the chosen nodes. The hash differs from round to round, so that a constant share
    of the nodes goes in each, whatever the shape of the graph.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stored(edges, "edges")
    rounds: list[DataFrame] = []
    while count := edges.count():
        turn = F.lit(len(rounds))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
        order = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("node"))
        chosen = stored(both.groupBy("v").agg(F.min(order("w")).alias("best")).select("v", F.least("best", order("v"))["node"].alias("to")).coalesce(tasks_for(2 * count)), "chosen")
        rounds.append(chosen)
        left = edges.join(chosen.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(chosen.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        old, edges = edges, stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct().coalesce(tasks_for(count)), "edges")
        drop_stored(old)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    made = rounds[0].select(F.col("v").alias("node"), F.col("to").alias("root"))
    for step in rounds[1:]:
        made = made.join(step.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    made = stored(made, "components")
    drop_stored(edges, *rounds)
    return made
