"""Mappings from event ids to the static part of events, and registries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import numbered
from .files import listed

MAPPING = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("function", T.StringType()), T.StructField("function_id", T.LongType()),
    T.StructField("var", T.StringType()), T.StructField("then_id", T.LongType()), T.StructField("else_id", T.LongType()), T.StructField("loop_id", T.LongType()), T.StructField("condition", T.StringType()),
])


def read_mapping(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of static events; or JSON lines, as write_mapping() leaves them."""
    return spark.read.schema(MAPPING).option("multiLine", not lines).json(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """JSON lines, in the order of the ids."""
    mapping.repartitionByRange("event_id").sortWithinPartitions("event_id").write.json(path)


def translated(mapping: DataFrame, translation: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """The mapping by translated ids. translation: event_id, new_id; ids without one keep their own. alternatives: more static
    events, for ids that the original doesn't have."""
    own = mapping if alternatives is None else mapping.unionByName(alternatives.join(mapping, "event_id", "left_anti"))
    joined = own.join(translation, "event_id", "left")
    return joined.withColumn("event_id", F.coalesce("new_id", "event_id")).drop("new_id")


def united(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both mappings; where they share an id, the right one's event."""
    return left.join(right, "event_id", "left_anti").unionByName(right)


def valid_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    return events.join(mapping.select("event_id"), "event_id", "left_semi")


def run_registry(spark: SparkSession, passing: str | list[str], failing: str | list[str]) -> DataFrame:
    """run_id, path, failing for the files of folders: passing runs first, each in the order of paths.

    Folders are rows: tasks list those of a level at once, and the paths found never meet on the driver. Empty logs are runs, and so is a
    path that was named and isn't there. Links to files are left out, and links to a folder around them, which would never end; names that
    begin with a dot or underscore are a store's own. A path under two of the folders named is two runs.
    """
    named = [(path, bad) for paths, bad in ((passing, False), (failing, True)) for path in ([paths] if isinstance(paths, str) else paths)]
    return numbered(listed(spark, named).select("path", "failing"), "run_id", "failing", "path").select("run_id", "path", "failing")
