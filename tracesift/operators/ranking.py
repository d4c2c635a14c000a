"""From scored features to places, ranks and measures of a ranking's quality."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(scores: DataFrame, *keep: str) -> DataFrame:
    """A row per feature and place that it points to, both ends of a feature with two."""
    ends = F.filter(F.array(F.struct(F.col("file"), F.col("line")), F.struct(F.col("file2").alias("file"), F.col("line2").alias("line"))), lambda e: e["line"].isNotNull())
    return scores.select(*keep, "score", F.explode(F.array_distinct(ends)).alias("place")).select(*keep, "score", "place.file", "place.line")


def expanded_places(scores: DataFrame, ranges: DataFrame, *keep: str, flip: bool = False) -> DataFrame:
    """Like places(), but features on a function, loop or branch point to all of its lines.

    ranges: kind (the feature's type), file, line, then (null unless a branch's side), first, last. Features without a range
    keep their own line. flip: branches point to their other side, as for the false side of a predicate.
    """
    side = F.when(F.col("type") == "BRANCH", F.col("feature").endswith(":then") != F.lit(flip))
    rows = scores.withColumn("_side", side)
    r = ranges.select(F.col("kind").alias("_kind"), F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("then").alias("_then"), "first", "last")
    joined = rows.join(r, (F.col("type") == F.col("_kind")) & (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")) & F.col("_side").eqNullSafe(F.col("_then")), "left")
    lines = F.when(F.col("first").isNotNull(), F.sequence("first", "last")).otherwise(F.array("line"))
    return joined.select(*keep, "score", "file", F.explode(lines).alias("line"))


def _with(df: DataFrame, per: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with what is known per group; of a single row, if there are no groups."""
    return df.join(per, [*by]) if by else df.crossJoin(per)


def suggestions(scores: DataFrame, *by: str) -> DataFrame:
    """score and place (file:line): a row for every place of features with the score, per group."""
    return places(scores, *by).select(*by, "score", F.concat_ws(":", "file", F.col("line").cast("string")).alias("place")).distinct()


def listed(suggested: DataFrame, *by: str) -> DataFrame:
    """For a report: the places of a score as one sorted list. A list holds all places of its score."""
    return suggested.groupBy(*by, "score").agg(F.array_sort(F.collect_set("place")).alias("places"))


def score_statistics(scores: DataFrame, *by: str) -> DataFrame:
    """Least, greatest, mean and upper median of the scores, per group. Equal scores are counted first."""
    per = scores.groupBy(*by, "score").agg(F.count("*").alias("_k"))
    total = scores.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 9).alias("mean"))
    so_far = F.sum("_k").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    median = _with(per.withColumn("_far", so_far), total.select(*by, "n"), by).where(F.col("_far") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min("score").alias("median"))
    return _with(total, median, by).select(*by, "n", "least", "most", "mean", "median")


def place_scores(scores: DataFrame, *by: str, how: str | Callable[[Column, Column], Column] = "max", start: float = -math.inf) -> DataFrame:
    """One score per place: the greatest, least or mean of those of its features, or a fold by how(score, so far).

    A fold goes over a place's distinct scores from the greatest to the least, as suggestions come, and begins with ``start``. Null scores take
    no part. Distinct scores of a place are few: counts of runs make them.
    """
    if callable(how):
        distinct = places(scores, *by).where("score is not null").groupBy(*by, "file", "line").agg(F.sort_array(F.collect_set("score"), asc=False).alias("_scores"))
        folded = F.aggregate("_scores", F.lit(float(start)), lambda so_far, score: how(score, so_far).cast("double"))
        return distinct.select(*by, "file", "line", folded.alias("score"))
    combine = {"max": F.max, "avg": lambda c: F.round(F.avg(c), 9), "min": F.min}[how]
    return places(scores, *by).groupBy(*by, "file", "line").agg(combine("score").alias("score"))


def place_sums(scores: DataFrame, *by: str) -> DataFrame:
    """Means of places as parts that can be kept and added: total and n per place. Parts must not share features."""
    return places(scores, *by).groupBy(*by, "file", "line").agg(F.sum("score").alias("total"), F.count("score").alias("n"))


def mean_of_sums(parts: DataFrame, *by: str) -> DataFrame:
    """The mean score per place of the parts of place_sums(), put together by union."""
    return parts.groupBy(*by, "file", "line").agg(F.round(F.try_divide(F.sum("total"), F.sum("n")), 9).alias("score"))


def ranks(place_scores_df: DataFrame, *by: str) -> DataFrame:
    """Adds rank, effort and tied. Of a group of n equal scores that begins at place r, all have the rank n/2 + r - 1 (r if
    alone) and the effort of its last place. The counts per score are few, so the running sum is over scores, not places."""
    per = place_scores_df.groupBy(*by, "score").agg(F.count("*").alias("tied"))
    order = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("effort", F.sum("tied").over(order)).withColumn("_first", F.col("effort") - F.col("tied") + 1)
    per = per.withColumn("rank", F.when(F.col("tied") == 1, F.col("_first").cast("double")).otherwise(F.col("tied") / 2 + F.col("_first") - 1)).drop("_first")
    return place_scores_df.join(per, [*by, "score"])


def top(ranked: DataFrame, n: int, *by: str) -> DataFrame:
    """Whole groups of equal scores until at least n places are in."""
    return ranked.where(F.col("effort") - F.col("tied") < n)


def _log_factorial(n: Column) -> Column:
    """From 20 on by Stirling's series; what it leaves out is below 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 20, F.log(F.factorial(F.greatest(n.cast("int"), F.lit(0))).cast("double"))).otherwise(series)


def choose(n: Column, k: Column) -> Column:
    """log of n over k, for closed forms of sampling."""
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def top_n_expected(ranked: DataFrame, faulty: DataFrame, n: int, *by: str) -> DataFrame:
    """Expected results of drawing n places of the top ones, in closed form.

    pool: places that the tie groups down to the n-th bring; found: faulty ones among them; and the expected share that is
    found (share), at least one found (best), all found (worst), half of them (average), with n drawn of the pool if it is larger.
    """
    pool = top(ranked, n, *by).join(faulty.select("file", "line", F.lit(1).alias("_bad")), ["file", "line"], "left")
    per = pool.groupBy(*by).agg(F.count("*").alias("pool"), F.count("_bad").alias("found"))
    per = per.crossJoin(F.broadcast(faulty.agg(F.count("*").alias("n_faulty"))))
    drawn = F.least(F.lit(n), F.col("pool")).cast("int")  # n at most
    found, size = F.col("found"), F.col("pool")
    none = F.when(size - found < drawn, 0.0).otherwise(F.exp(choose(size - found, drawn) - choose(size, drawn)))
    chance = lambda x: F.when((x > found) | (drawn - x > size - found), 0.0).otherwise(F.exp(choose(found, x) + choose(size - found, drawn - x) - choose(size, drawn)))
    half = F.aggregate(F.sequence(F.lit(0), drawn), F.lit(0.0), lambda acc, x: acc + chance(x) * F.least(F.try_divide(2.0 * x, F.col("n_faulty")), F.lit(1.0)))
    expected = drawn * F.col("found") / F.col("pool")
    return per.select(*by, "pool", "found", F.round(F.col("found") / F.col("pool"), 9).alias("share"), F.round(1 - none, 9).alias("best"), F.round(F.coalesce(F.try_divide(expected, F.col("n_faulty")), F.lit(0.0)), 9).alias("worst"), F.round(F.coalesce(half, F.lit(0.0)), 9).alias("average"))


def fault_ranks(ranked: DataFrame, faulty: DataFrame, *by: str, total: int | None = None) -> DataFrame:
    """Of the faulty places of each group: best, worst, middle (the lower one of the middle) and mean of their exam scores, which are
    ranks over the number of places, and of their efforts, the last places of their tie groups.

    total: how many places there are, ranked or not; all are ranked unless given. A faulty place that isn't ranked has the mean
    rank of the unranked ones, and all places as effort.
    """
    size = ranked.groupBy(*by).agg(F.count("*").alias("_n"), F.max("effort").alias("_last")).withColumn("n_places", F.col("_n") if total is None else F.lit(total))
    measures = lambda rank, effort: F.explode(F.array(F.struct(F.lit("exam").alias("m"), (rank / F.col("n_places")).alias("v")), F.struct(F.lit("effort").alias("m"), effort.cast("double").alias("v")))).alias("x")
    found = ranked.join(faulty.select("file", "line"), ["file", "line"])
    seen = _with(found.select(*by, "rank", "effort"), size, by).select(*by, "n_places", measures(F.col("rank"), F.col("effort")), F.lit(1).cast("long").alias("n"))
    # Faults without a rank all have the same one, so they are a row per group with their number.
    ranked_faults = found.groupBy(*by).agg(F.count("*").alias("_found"))
    missing = size.join(ranked_faults, [*by], "left") if by else size.crossJoin(ranked_faults)
    missing = missing.crossJoin(F.broadcast(faulty.agg(F.count("*").alias("_faults")))).withColumn("n", F.col("_faults") - F.coalesce("_found", F.lit(0)))
    rest = missing.where("n > 0").select(*by, "n_places", measures((F.col("n_places") - F.col("_n")) / 2 + F.col("_last"), F.col("n_places")), "n")
    per = seen.unionByName(rest).groupBy(*by, "n_places", "x.m", "x.v").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "n_places", "m")
    per = per.withColumn("_far", F.sum("n").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    all_ = per.groupBy(*by, "n_places", "m").agg(F.sum("n").alias("_all"), F.min("v").alias("best"), F.max("v").alias("worst"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    middle = per.join(all_.select(*by, "n_places", "m", "_all"), [*by, "n_places", "m"]).where(F.col("_far") > F.greatest(F.floor(F.col("_all") / 2) - 1, F.lit(0))).groupBy(*by, "n_places", "m").agg(F.min("v").alias("middle"))
    both = all_.join(middle, [*by, "n_places", "m"])
    value = lambda m, n: F.round(F.max(F.when(F.col("m") == m, F.col(n))), 9).alias(f"{m}_{n}")
    return both.groupBy(*by, "n_places").agg(*(value(m, n) for m in ("exam", "effort") for n in ("best", "worst", "middle", "mean")))


def precision_at(ranked: DataFrame, faulty: DataFrame, k: int, *by: str) -> DataFrame:
    """Precision and recall of the first k places, with all that tie with the first score taken in."""
    first = ranked.groupBy(*by).agg(F.max("score").alias("_top"))
    taken = _with(ranked, first, by).where((F.col("effort") - F.col("tied") < k) | (F.col("score") == F.col("_top"))).drop("_top")
    joined = taken.join(faulty.select("file", "line", F.lit(1).alias("_bad")), ["file", "line"], "left")
    per = joined.groupBy(*by).agg(F.count("*").alias("taken"), F.count("_bad").alias("hits")).crossJoin(F.broadcast(faulty.agg(F.count("*").alias("n_faulty"))))
    return per.select(*by, "taken", "hits", F.round(F.col("hits") / F.col("taken"), 9).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "n_faulty"), F.lit(0.0)), 9).alias("recall"))
