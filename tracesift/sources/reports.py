"""Analyses and results as files: dumps of counts, reports of suggestions, test results, diffs and source ranges."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PREDICATES, SPECTRA

COUNTS = "type string, feature string, file string, line int, file2 string, line2 int, ef double, nf double, ep double, np double, f double, p double, tr double, ti double, fr double, fi double"


def dump_counts(counts: DataFrame, path: str) -> None:
    """An analysis as JSON lines, told apart by type."""
    counts.write.json(path)


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    """A dumped analysis. It can be scored and ranked again, not counted anew."""
    return spark.read.schema(COUNTS).json(path)


#: Fields that an analysis of a kind must have when it is loaded, by their types.
_ALWAYS = {"feature": "string", "file": "string", "line": "int", "ef": "double", "nf": "double", "ep": "double", "np": "double", "f": "double", "p": "double"}
_ENDS, _TRUTHS = {"file2": "string", "line2": "int"}, {"tr": "double", "ti": "double", "fr": "double", "fi": "double"}
MANDATORY = {kind: _ALWAYS | (_ENDS if kind == "DEF_USE" else {}) | (_TRUTHS if kind in PREDICATES else {}) for kind in (*SPECTRA, *PREDICATES)}


def dump_typed(counts: DataFrame, path: str) -> None:
    """An analysis as a table of type and body, a VARIANT with the fields that the row has: those that are null are left out."""
    body = F.parse_json(F.to_json(F.struct(*(c for c in counts.columns if c != "type"))))
    counts.select("type", body.alias("body")).write.parquet(path)


def checked_rows(dumped: DataFrame) -> DataFrame:
    """type and body with missing: the mandatory fields of the kind that the body lacks or holds in another type; ["type"] for a kind that is
    unknown. Other fields don't matter."""
    lacks = lambda name, kind: F.when(F.try_variant_get("body", f"$.{name}", kind).isNull(), F.lit(name))
    missing = F.lit(None).cast("array<string>")
    for kinds in sorted({tuple(sorted(k for k, f in MANDATORY.items() if f == fields)) for fields in MANDATORY.values()}):
        fields = MANDATORY[kinds[0]]
        missing = F.when(F.col("type").isin(*kinds), F.array_compact(F.array(*(lacks(n, t) for n, t in fields.items())))).otherwise(missing)
    return dumped.select("type", "body", F.coalesce(missing, F.array(F.lit("type"))).alias("missing"))


def load_typed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows of dump_typed() that have all mandatory fields, as counts; and those that don't: type, body (JSON) and missing."""
    rows = checked_rows(spark.read.schema("type string, body variant").parquet(path))
    fields = [f.split() for f in COUNTS.split(", ")][1:]
    good = rows.where(F.size("missing") == 0).select("type", *(F.try_variant_get("body", f"$.{n}", t).alias(n) for n, t in fields))
    return good, rows.where(F.size("missing") > 0).select("type", F.to_json("body").alias("body"), "missing")


def report(suggestions: DataFrame) -> DataFrame:
    """type, metric, score and places to a JSON text per type: metrics with their suggestions, best first."""
    item = F.struct((-F.col("score")).alias("order"), F.struct(F.col("places").alias("locations"), F.col("score").alias("suspiciousness")).alias("s"))
    per = suggestions.groupBy("type", "metric").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("list"))
    return per.groupBy("type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "list"))))).alias("report"))


def test_outcome(passed: Column, failed: Column, timeout: Column | None = None) -> Column:
    """PASSING if some tests passed and none failed, FAILING if the other way round, else UNDEFINED."""
    known = F.when((passed > 0) & (failed == 0), "PASSING").when((failed > 0) & (passed == 0), "FAILING").otherwise("UNDEFINED")
    return known if timeout is None else F.when(timeout, "UNDEFINED").otherwise(known)


def safe_name(name: Column, longest: int = 255) -> Column:
    """A file name for a test: other characters become underscores, long names their checksum."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x00-\x7f]", ""), r"[^A-Za-z0-9]", "_")
    return F.when(F.length(plain) > longest, F.md5(name.cast("binary"))).otherwise(plain)


def junit_results(spark: SparkSession, path: str) -> DataFrame:
    """test and result (PASSED or FAILED) of JUnit XML files. A case with a failure or an error failed; one with no more than
    output passed; others, as skipped ones, are left out."""
    tags = ("failure", "error", "skipped", "properties", "rerunFailure", "rerunError", "flakyFailure", "flakyError")
    schema = ", ".join(["_classname string", "_name string", *(f"`{t}` array<struct<_VALUE: string, _message: string, _type: string>>" for t in tags)])
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    there = lambda *names: F.greatest(*(F.col(n).isNotNull() for n in names))
    result = F.when(there("failure", "error"), "FAILED").when(~there(*tags[2:]), "PASSED")
    return cases.select(F.concat_ws("::", "_classname", "_name").alias("test"), result.alias("result")).where("result is not null")


def consistent_runs(runs: DataFrame, original: DataFrame) -> DataFrame:
    """The runs whose result is the same without instrumentation. Both: test, result."""
    return runs.join(original.select("test", F.col("result").alias("_r")), "test").where(F.col("result") == F.col("_r")).drop("_r")


def diff_places(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """File and old line number of every line of a unified diff's hunks, beside the other columns of diffs: removed lines and those around
    them. An added line has the place of the old line before it, or else, where its file's changes begin, its own number."""
    keys = [c for c in diffs.columns if c != text_col]
    rows = diffs.select(*keys, F.posexplode(F.split(text_col, "\\r?\\n")).alias("pos", "text"))
    text = F.col("text")
    until = lambda *more: Window.partitionBy(*keys, *more).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = text.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    number = lambda i: F.regexp_extract(text, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    size = lambda i: F.coalesce(number(i).try_cast("int"), F.lit(1))
    rows = rows.withColumn("_hunk", F.sum(header.cast("int")).over(until()))
    rows = rows.withColumn("_h", F.last(F.when(header, F.struct(number(1).try_cast("int").alias("old"), size(2).alias("olds"), number(3).try_cast("int").alias("new"), size(4).alias("news"))), True).over(until()))
    # Lines of a hunk's body are those that its header's counts take in, whatever they begin with.
    old, new = (F.when(header, 0).when(text.startswith(sign) | text.startswith(" ") | (text == ""), 1).otherwise(0) for sign in ("-", "+"))
    before = Window.partitionBy(*keys, "_hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_old", F.coalesce(F.sum(old).over(before), F.lit(0))).withColumn("_new", F.coalesce(F.sum(new).over(before), F.lit(0)))
    body = ~header & (F.col("_hunk") > 0) & ((F.col("_old") < F.col("_h.olds")) | (F.col("_new") < F.col("_h.news"))) & ~text.startswith("\\")
    rows = rows.withColumn("_body", body)
    name = F.when(~F.col("_body") & text.startswith("--- "), F.regexp_extract(text, r"^--- (?:a/)?([^\t]*)", 1))
    rows = rows.withColumn("file", F.last(name, True).over(until())).withColumn("_part", F.count(name).over(until()))
    rows = rows.where("_body").withColumn("_add", text.startswith("+"))
    line = F.when(~F.col("_add"), F.col("_h.old") + F.col("_old"))
    first = F.first(F.when(F.col("_add"), F.col("_h.new") + F.col("_new")), True).over(until("_part"))
    rows = rows.withColumn("line", F.coalesce(F.last(line, True).over(until("_part")), first).cast("int"))
    return rows.select(*keys, "file", "line").distinct()


def source_ranges(sources: DataFrame) -> DataFrame:
    """kind, file, line, then, first, last of the functions, loops and branches of Python sources (file, text). The test of a branch
    belongs to both of its sides; a side that lies apart from it has two rows."""
    return sources.select("file", "text").mapInArrow(_range_batches, "kind string, file string, line int, then boolean, first int, last int")


#: Rows that a task holds before it hands them on.
RANGE_ROWS = 10_000
_RANGES = pa.schema([("kind", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("then", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])


def _ranges(tree: ast.AST) -> Iterator[tuple]:
    """kind, line, then, first and last of a source."""
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for kind in ("FUNCTION", "FUNCTION_ERROR"):
                yield kind, node.lineno, None, node.lineno, node.end_lineno
        elif isinstance(node, ast.For | ast.AsyncFor | ast.While):
            yield "LOOP", node.lineno, None, node.lineno, node.end_lineno
        elif isinstance(node, ast.If):
            yield "BRANCH", node.lineno, True, node.lineno, node.body[-1].end_lineno
            yield "BRANCH", node.lineno, False, node.lineno, node.test.end_lineno
            if node.orelse:
                yield "BRANCH", node.lineno, False, node.orelse[0].lineno, node.orelse[-1].end_lineno


def _range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for file, text in zip(batch.column(0), batch.column(1), strict=True):
            try:
                tree = ast.parse(text.as_py() or "")
            except (SyntaxError, ValueError):
                continue
            for found in _ranges(tree):
                rows.append((found[0], file.as_py(), *found[1:]))
                if len(rows) == RANGE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANGES, strict=True)], schema=_RANGES)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANGES, strict=True)], schema=_RANGES)


#: Red, green and blue of marks without, with middling and with full suspicion.
GREEN, YELLOW, RED = (179, 230, 179), (255, 255, 153), (255, 153, 153)


def colored(place_scores: DataFrame) -> DataFrame:
    """file, line, percent and a color between green, yellow and red, for the greatest score of each place."""
    top = place_scores.groupBy("file", "line").agg(F.max("score").alias("score"))
    share = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    low, high = lambda g, y: 2 * (share * y + (0.5 - share) * g), lambda y, r: 2 * ((1 - share) * y + (share - 0.5) * r)
    channels = [F.when(share <= 0.5, low(float(g), float(y))).otherwise(high(float(y), float(r))) for g, y, r in zip(GREEN, YELLOW, RED, strict=True)]
    hex2 = [F.lower(F.lpad(F.hex(F.bround(c).cast("long")), 2, "0")) for c in channels]
    return top.select("file", "line", F.floor(share * 100).cast("int").alias("percent"), F.concat(F.lit("#"), *hex2).alias("color"))


def listing(lines: DataFrame, place_scores: DataFrame) -> DataFrame:
    """file, line and html of source lines (file, line, text): numbered, marked by color, with a tooltip that says how suspicious they are."""
    marks = colored(place_scores)
    text = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    text = F.when(F.trim(text) == "", "&nbsp;").otherwise(text)
    number = F.col("line").cast("string")
    numbered = F.concat(F.when(F.length(number) < 4, F.lpad(number, 4, " ")).otherwise(number), F.lit(" "), text)
    tip = F.concat(F.lit("Line "), number, F.lit(": "), F.coalesce(F.concat(F.lpad(F.col("percent").cast("string"), 3, " "), F.lit("%")), F.lit("not executed")))
    plain = F.concat(F.lit('<pre title="'), tip, F.lit('">'), numbered, F.lit("</pre>"))
    marked = F.concat(F.lit('<pre style="background-color:'), F.col("color"), F.lit('" title="'), tip, F.lit('">'), F.rtrim(numbered), F.lit("</pre>"))
    return lines.join(marks, ["file", "line"], "left").select("file", "line", F.coalesce(marked, plain).alias("html"))
