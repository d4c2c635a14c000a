"""Traces made of the driver's tables: every table row is an event of a run.

The events table gives one event per row. Its user is the run, time gives the order; kind, place and values follow from
the row's type and its number k. A variant chooses which kinds of event the five row types become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENT_CODES

#: Row type to event kind, by variant; two kinds: for even and odd k.
VARIANTS = {
    "scopes": {"click": ("LINE",) * 2, "view": ("USE",) * 2, "purchase": ("DEF",) * 2, "signup": ("FUNCTION_ENTER",) * 2, "error": ("FUNCTION_EXIT", "FUNCTION_ERROR")},
    "loops": {"signup": ("LOOP_BEGIN",) * 2, "click": ("LOOP_HIT",) * 2, "view": ("LOOP_HIT",) * 2, "error": ("LOOP_END",) * 2, "purchase": ("LOOP_END",) * 2},
    "flow": {"click": ("LINE",) * 2, "view": ("BRANCH",) * 2, "purchase": ("CONDITION",) * 2, "signup": ("LEN",) * 2, "error": ("LINE",) * 2},
    "tests": {"click": ("TEST_LINE",) * 2, "view": ("TEST_USE",) * 2, "purchase": ("LINE",) * 2, "signup": ("TEST_DEF", "TEST_START"), "error": ("TEST_END", "TEST_ASSERT")},
}
#: Values of an error row from which its run counts as failing.
FAILING_VALUE = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def trace(spark: SparkSession, sf_dir: str, variant: str = "scopes", threads: int = 0, main: bool = False) -> DataFrame:
    """The events table as events of a variant. threads: how many threads a run's events are dealt to; 0: none are named. main: the first
    of them is the main thread, which has no id."""
    thread = F.col("event_id") % threads if threads else F.lit(None)
    k = F.col("k")
    kind = None
    for source, (even, odd) in VARIANTS[variant].items():
        test = F.col("row_type") == source
        value = F.when(k % 2 == 0, even).otherwise(odd) if even != odd else F.lit(even)
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("row_type"), "value", number_of(F.col("props")).alias("k"))
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return rows.select(
        "run_id",
        F.row_number().over(order).cast("long").alias("seq"),
        (F.nullif(thread, F.lit(0)) if main else thread).cast("long").alias("thread_id"),
        "event_id",
        kind.alias("event_type"),
        F.concat(F.lit("f"), (k % 5).cast("string")).alias("file"),
        (k % 19 + 1).cast("int").alias("line"),
        F.concat(F.lit("fn"), (k % 7).cast("string")).alias("function"),
        (k % 7).cast("long").alias("function_id"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("var"),
        (k % 4).cast("long").alias("var_id"),
        F.when(k % 10 != 9, F.col("value") - 50).alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(None).cast("binary").alias("value_bin"),
        (F.col("value") > 60).alias("value_bool"),
        F.when(k % 10 != 9, "float").otherwise("NoneType").alias("value_type"),
        (2 * (k % 10) + F.when(F.col("value") > 60, 1).otherwise(0)).cast("long").alias("then_id"),
        F.when(k % 10 == 9, -1).otherwise(2 * (k % 10) + F.when(F.col("value") > 60, 0).otherwise(1)).cast("long").alias("else_id"),
        (k % 3).cast("long").alias("loop_id"),
        F.concat(F.lit("c"), (k % 6).cast("string")).alias("condition"),
        (k % 4).cast("long").alias("length"),
        "k",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id and failing, for every run of the events table."""
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").alias("run_id")).agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > FAILING_VALUE)).alias("failing"))


def document_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs that define string variables: language, source, first word, an empty one at times, the
    whole text; and one of bytes, empty in every second."""
    docs = table(spark, sf_dir, "documents")
    first = F.coalesce(F.regexp_extract("text", r"^\s*(\S+)", 1), F.lit(""))
    strings = F.array(
        F.struct(F.lit("lang").alias("var"), F.lit(1).alias("line"), F.col("lang").alias("v")),
        F.struct(F.lit("source").alias("var"), F.lit(2).alias("line"), F.col("source").alias("v")),
        F.struct(F.lit("first").alias("var"), F.lit(3).alias("line"), first.alias("v")),
        F.struct(F.lit("odd").alias("var"), F.lit(4).alias("line"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("n_chars").cast("string")).alias("v")),
        F.struct(F.lit("text").alias("var"), F.lit(5).alias("line"), F.col("text").alias("v")),
        F.struct(F.lit("raw").alias("var"), F.lit(6).alias("line"), F.when(F.col("doc_id") % 2 == 1, "").otherwise(F.coalesce("lang", F.lit("-"))).alias("v")),
    )
    raw = F.col("s.var") == "raw"
    return docs.select("doc_id", F.posexplode(strings).alias("pos", "s")).select(
        F.col("doc_id").alias("run_id"), (F.col("pos") + 1).cast("long").alias("seq"), F.lit("DEF").alias("event_type"), F.lit("docs").alias("file"), F.col("s.line").alias("line"),
        F.col("s.var").alias("var"), F.col("pos").cast("long").alias("var_id"), F.lit(None).cast("double").alias("value_num"), F.when(~raw, F.col("s.v")).alias("value_str"), F.when(raw, F.col("s.v").cast("binary")).alias("value_bin"),
        F.when(raw, "bytes").when(F.col("s.v").isNull(), "NoneType").otherwise("str").alias("value_type"),
    )


def valued(events: DataFrame) -> DataFrame:
    """Events with values of every kind in turn, by their number k: float, int, str, bytes, None; an empty one of the latter at times."""
    kind = F.col("k") % 5
    text = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("v"), F.col("k").cast("string")))
    return events.withColumns({
        "value_num": F.when(kind == 0, F.col("k") / 4).when(kind == 1, (F.col("k") - 50).cast("double")),
        "value_str": F.when(kind == 2, text), "value_bin": F.when(kind == 3, text.cast("binary")),
        "value_type": F.element_at(F.array(*map(F.lit, ("float", "int", "str", "bytes", "NoneType"))), kind + 1),
    })


def program_place(events: DataFrame) -> DataFrame:
    """Events by the id of their place in the program: kind and number k make it, so ids don't grow with the log."""
    codes = F.create_map(*(F.lit(x) for code, kind in EVENT_CODES.items() for x in (kind, code)))
    return events.withColumn("event_id", (F.col("k") * 100 + F.element_at(codes, F.col("event_type"))).cast("long"))


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id and failing for labelled documents: poor or toxic ones fail."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("failing"))


def order_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as LINE events of their order's run: return flag and line status are the file."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit("LINE").alias("event_type"), F.concat("l_returnflag", "l_linestatus").alias("file"), F.col("l_linenumber").cast("int").alias("line"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("failing"))
