"""Feature vectors: what each run says of each feature, as rows, packed into words, and wide.

Packed vectors number the features densely and hold two bits for each, 32 to a word. The bits tell how a value differs from the feature's
default, so a run has words only where it observed something, and two runs differ where their words do.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PREDICATES
from ..shared import stored
from .extractors import EXTRACTORS
from .scan import dealt, numbered

TRUE, FALSE, UNDEFINED = 1, 0, -1
#: Columns of features in one table; matrices() makes as many tables as it takes.
MOST_COLUMNS = 5_000
#: Features of a word, and bytes of names up to which a dictionary is broadcast.
WORD, NAMES_BROADCAST = 32, 32 << 20


def feature_values(observations: DataFrame) -> DataFrame:
    """run_id, feature, type, value: the first truth written stays, by the event's order, then by the extractors'."""
    order = F.struct("seq", F.array_position(F.array(*map(F.lit, EXTRACTORS)), F.col("type")).alias("o"), F.lit(1) - F.col("truth"))
    return observations.groupBy("run_id", "feature", "type").agg(F.min_by("truth", order).alias("value"))


def printed_name() -> Column:
    """How a feature is printed: by type, place and key, without the class of a loop and the negation of a condition, which collide so."""
    kind = F.col("type")
    start = F.concat_ws(":", kind, "file", F.col("line").cast("string"))
    rest = F.substring(F.col("feature"), F.length(start) + 2, F.length("feature"))
    part = lambda i: F.get(F.split(rest, ":"), F.lit(i))
    with_rest = lambda text: F.concat_ws(":", start, text)
    return (
        F.when(kind.isin("LINE", "LOOP"), start)
        .when(kind.isin("FUNCTION", "FUNCTION_ERROR"), F.concat_ws(":", kind, "file", rest, F.col("line").cast("string")))
        .when(kind == "CONDITION", with_rest(F.regexp_replace(rest, ":(is|not)$", "")))
        .when(kind == "BRANCH", with_rest(F.concat_ws(":", part(1), part(0))))
        .when(kind == "VARIABLE", with_rest(F.concat(part(0), part(1), F.lit("0"))))
        .when(kind.isin("SCALAR_PAIR", "RETURN"), with_rest(F.replace(rest, F.lit(":"))))
        .when(kind == "LENGTH", with_rest(F.concat_ws(":", part(0), F.concat(F.lit("evaluate_length_"), part(1)))))
        .otherwise(F.col("feature"))
    )


def printed_values(observations: DataFrame) -> DataFrame:
    """run_id, name, type, value: as feature_values(), by printed names. Of features that share one, at one event, the class 0 of a loop and the
    negated condition come first."""
    later = F.when(F.col("type") == "LOOP", (~F.col("feature").endswith(":0")).cast("int")).when(F.col("type") == "CONDITION", F.col("feature").endswith(":is").cast("int")).otherwise(0)
    order = F.struct("seq", F.array_position(F.array(*map(F.lit, EXTRACTORS)), F.col("type")).alias("o"), later.alias("later"), F.lit(1) - F.col("truth"))
    return observations.withColumn("name", printed_name()).groupBy("run_id", "name", "type").agg(F.min_by("truth", order).alias("value"))


def default_value(kind: Column) -> Column:
    """Predicates that a run didn't observe are undefined, spectra are false."""
    return F.when(kind.isin(*PREDICATES), UNDEFINED).otherwise(FALSE)


def complete(values: DataFrame, runs: DataFrame) -> DataFrame:
    """A value for every run and feature. The cross product is the result itself: run by feature."""
    features = values.select("feature", "type").distinct()
    return runs.select("run_id").crossJoin(features).join(values, ["run_id", "feature", "type"], "left").select("run_id", "feature", "type", F.coalesce("value", default_value(F.col("type"))).alias("value"))


def dictionary_of(values: DataFrame) -> DataFrame:
    """feature, type, number: the features in order, numbered from 0 without gaps."""
    return numbered(values.select("feature", "type").distinct(), "number", "feature", "type")


def packed(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors as words (run_id, word, bits), and the dictionary of their features."""
    values = stored(values, "values")
    dictionary = stored(dictionary_of(values), "dictionary")
    code = (F.col("value") + 1).bitwiseXOR(default_value(F.col("type")) + 1).cast("long")
    numbered = values.join(dictionary, ["feature", "type"]).select("run_id", "number", code.alias("code"))
    bits = F.expr(f"shiftleft(code, cast(2 * (number % {WORD}) as int))")
    return numbered.groupBy("run_id", F.floor(F.col("number") / WORD).alias("word")).agg(F.bit_or(bits).alias("bits")), dictionary


def unpacked(words: DataFrame, dictionary: DataFrame, runs: DataFrame) -> DataFrame:
    """A value for every run and feature: run by feature is the result itself. Each run gets its words, those it lacks among them, and each
    word its features."""
    facts = dictionary.agg(F.max("number").alias("last"), F.sum(F.octet_length("feature") + 16).alias("bytes")).first()
    if facts.last is None:
        return runs.select("run_id", F.lit("").alias("feature"), F.lit("").alias("type"), F.lit(0).alias("value")).limit(0)
    every = runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(facts.last // WORD).cast("long"))).alias("word"))
    every = every.join(words, ["run_id", "word"], "left")
    names = dictionary.select("feature", "type", F.floor(F.col("number") / WORD).alias("word"), (2 * (F.col("number") % WORD)).cast("int").alias("shift"))
    both = every.join(F.broadcast(names) if facts.bytes <= NAMES_BROADCAST else names, "word")
    code = F.expr("shiftrightunsigned(coalesce(bits, 0L), shift) & 3L").cast("int")
    return both.select("run_id", "feature", "type", (code.bitwiseXOR(default_value(F.col("type")) + 1) - 1).alias("value"))


def packed_differences(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hamming distances of pairs of runs (a, b), both with a word: features whose two bits differ, counted a word at a time."""
    words = stored(words, "words")
    left = pairs.join(words.select(F.col("run_id").alias("a"), "word", F.col("bits").alias("x")), "a")
    right = pairs.join(words.select(F.col("run_id").alias("b"), "word", F.col("bits").alias("y")), "b")
    both = left.join(right, ["a", "b", "word"], "full")
    apart = F.coalesce("x", F.lit(0)).bitwiseXOR(F.coalesce("y", F.lit(0)))
    return both.groupBy("a", "b").agg(F.sum(F.bit_count(apart.bitwiseOR(F.shiftrightunsigned(apart, 1)).bitwiseAND(F.lit(0x5555555555555555)))).cast("long").alias("difference"))


def without_runs(values: DataFrame, removed: DataFrame) -> DataFrame:
    """The values of all runs but those removed (run_id), with the features that others observed."""
    return values.join(removed.select("run_id"), "run_id", "left_anti")


def wide(values: DataFrame, runs: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """A row per run: run_id, failing, test if runs have one, the label if given, and a column for each of the features given, by name."""
    cells = values.where(F.col("feature").isin(*features))
    kind = {f: f.split(":", 1)[0] for f in features}
    pivoted = cells.groupBy("run_id").pivot("feature", sorted(features)).agg(F.first("value"))
    own = ["test"] if "test" in runs.columns else []
    joined = runs.select("run_id", *own, F.col("failing").cast("int").alias("failing")).join(pivoted, "run_id", "left")
    return joined.select("run_id", *own, "failing", *([F.lit(label).alias("label")] if label is not None else []), *(F.coalesce(F.col(f"`{f}`"), F.lit(UNDEFINED if kind[f] in PREDICATES else FALSE)).alias(f) for f in sorted(features)))


def matrices(values: DataFrame, runs: DataFrame, label: str | None = None, most: int = MOST_COLUMNS) -> Iterator[DataFrame]:
    """wide() for all features, so many to a table. The driver holds the names of one table at a time."""
    dictionary = stored(dictionary_of(values), "dictionary")
    for start in range(0, (dictionary.agg(F.max("number")).first()[0] or 0) + 1, most):
        names = [r.feature for r in dictionary.where((F.col("number") >= start) & (F.col("number") < start + most)).select("feature").collect()]  # most at most
        yield wide(values, runs, names, label)


def next_runs(runs: DataFrame) -> DataFrame:
    """Pairs (a, b) of each run and that with the next id. Ids are dealt out by ranges, and only the least of each range
    meet in one window."""
    ids = runs.select("run_id").where("run_id is not null").distinct()
    rows = dealt(ids, "run_id")
    inside = rows.select("part", F.col("run_id").alias("a"), F.lead("run_id").over(Window.partitionBy("part").orderBy("run_id")).alias("b"))
    least = rows.groupBy("part").agg(F.min("run_id").alias("least"))
    after = least.select("part", F.lead("least").over(Window.orderBy("part")).alias("after"))  # a row per range
    return inside.join(F.broadcast(after), "part").select("a", F.coalesce("b", "after").alias("b")).where("b is not null")


def differences(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hamming distances of pairs of runs (a, b) over the features that either observed."""
    left = pairs.join(values.select(F.col("run_id").alias("a"), "feature", F.col("value").alias("va"), "type"), "a")
    right = pairs.join(values.select(F.col("run_id").alias("b"), "feature", F.col("value").alias("vb"), "type"), "b")
    both = left.join(right, ["a", "b", "feature", "type"], "full")
    fill = default_value(F.col("type"))
    return both.groupBy("a", "b").agg(F.sum((F.coalesce("va", fill) != F.coalesce("vb", fill)).cast("long")).alias("difference"))


def either(a: Column, b: Column) -> Column:
    """TRUE if one is, else FALSE if one is, else UNDEFINED."""
    return F.greatest(a, b)


def negated(a: Column) -> Column:
    return F.when(a == UNDEFINED, a).otherwise(1 - a)


def merged(values: DataFrame, *by: str) -> DataFrame:
    """One vector for several runs: a feature is true if it is in any, else false if any observed it."""
    return values.groupBy(*by, "feature", "type").agg(F.max("value").alias("value"))
