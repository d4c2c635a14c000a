"""Event logs as text: type,file,line,event_id and, for branches, then_id,else_id. A file is a run, its lines are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENT_CODES
from . import files
from .binary_log import STRETCH


def read_csv_logs(spark: SparkSession, path: str, run: Column | None = None) -> DataFrame:
    """The events of all files below path, with the file's path as log (or run as run_id). Lines that can't be read end the log.

    Large files are split. Splits of a file are ordered by where they begin, and lines of a split by a number that grows within its task.
    """
    known = [run.alias("run_id")] if run is not None else []
    here = files.local_path(spark, path)
    if here is not None:
        lines = files.read_lines(spark, here).withColumn("_metadata", F.struct(F.col("path").alias("file_path")))
        return parse_csv_lines(lines.select(F.col("_metadata.file_path").alias("log"), *known, "pos", F.col("value").cast("string").alias("text")))
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("log"), *known, F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    order = Window.partitionBy("log").orderBy("_split", "_at")
    return parse_csv_lines(lines.withColumn("pos", F.row_number().over(order) - 1).drop("_split", "_at"))


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """lines: text and pos (from 0), beside the columns that tell the log."""
    keys = [c for c in lines.columns if c not in ("pos", "text")]
    part = F.split("text", ",", -1)
    number = lambda i, kind: F.get(part, F.lit(i)).try_cast(kind)
    code = number(0, "int")
    kinds = F.create_map(*(F.lit(x) for pair in EVENT_CODES.items() for x in pair))
    rows = lines.select(*keys, (F.col("pos") + 1).cast("long").alias("seq"), F.try_element_at(kinds, code).alias("event_type"), F.get(part, F.lit(1)).alias("file"), number(2, "int").alias("line"), number(3, "long").alias("event_id"), number(4, "long").alias("then_id"), number(5, "long").alias("else_id"))
    good = F.col("event_type").isNotNull() & F.col("line").isNotNull() & F.col("event_id").isNotNull()
    bad = rows.where(~good).groupBy(*keys).agg(F.min("seq").alias("_end"))
    return rows.join(bad, keys, "left").where(F.col("_end").isNull() | (F.col("seq") < F.col("_end"))).drop("_end")


def csv_lines(events: DataFrame) -> Column:
    """The line of text that stands for an event."""
    codes = F.create_map(*(F.lit(x) for kind, code in ((v, k) for k, v in EVENT_CODES.items()) for x in (kind, code)))
    common = [F.element_at(codes, F.col("event_type")).cast("string"), F.col("file"), F.col("line").cast("string"), F.col("event_id").cast("string")]
    return F.concat_ws(",", *common, *(F.when(F.col("event_type") == "BRANCH", F.col(c).cast("string")) for c in ("then_id", "else_id")))


def write_csv_logs(events: DataFrame, path: str) -> None:
    """A file run_id=... .csv per run, in one folder. The rows of a run are sorted and streamed into its file."""
    name = F.concat(F.lit("run_id="), F.coalesce(F.col("run_id").cast("string"), F.lit("null")), F.lit(".csv"))
    files.write_texts(events.select(name.alias("name"), "seq", csv_lines(events).alias("value")), path, "seq")


def text_logs(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """run_id, chunk and content: text logs of a run's events by stretches of their seq (from 1), as containers take them."""
    lines = events.select("run_id", F.floor((F.col("seq") - 1) / stretch).alias("chunk"), F.struct("seq", csv_lines(events).alias("line")).alias("l"))
    per = lines.groupBy("run_id", "chunk").agg(F.array_sort(F.collect_list("l")).alias("l"))  # a stretch at most
    return per.select("run_id", "chunk", F.encode(F.array_join("l.line", "\n"), "UTF-8").alias("content"))


def parse_text_logs(logs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The events of text_logs(), with run_id and seq. Lines that can't be read end their run."""
    lines = logs.select("run_id", "chunk", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "text"))
    return parse_csv_lines(lines.select("run_id", (F.col("chunk") * stretch + F.col("at")).alias("pos"), "text"))
