"""The canonical event row: one wide, nullable struct, told apart by event_type."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("thread_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("function", T.StringType()),
    T.StructField("function_id", T.LongType()),
    T.StructField("var", T.StringType()),
    T.StructField("var_id", T.LongType()),
    T.StructField("value_num", T.DoubleType()),
    T.StructField("value_str", T.StringType()),
    T.StructField("value_bin", T.BinaryType()),
    T.StructField("value_bool", T.BooleanType()),
    T.StructField("value_type", T.StringType()),
    T.StructField("then_id", T.LongType()),
    T.StructField("else_id", T.LongType()),
    T.StructField("loop_id", T.LongType()),
    T.StructField("condition", T.StringType()),
    T.StructField("length", T.LongType()),
])

#: The numeric codes of event kinds in logs.
EVENT_CODES = {
    0: "LINE", 1: "BRANCH", 2: "FUNCTION_ENTER", 3: "FUNCTION_EXIT", 4: "FUNCTION_ERROR", 5: "DEF", 6: "USE", 7: "CONDITION",
    8: "LOOP_BEGIN", 9: "LOOP_HIT", 10: "LOOP_END", 11: "LEN", 12: "TEST_START", 13: "TEST_END", 14: "TEST_LINE", 15: "TEST_DEF", 16: "TEST_USE", 17: "TEST_ASSERT",
}

#: What every extractor returns. file2 and line2: the other end of a feature with two places. truth: 1, 0.
OBSERVATION = ["type", "feature", "file", "line", "file2", "line2", "run_id", "seq", "truth"]

SPECTRA = ("LINE", "FUNCTION", "DEF_USE", "LOOP", "LENGTH")
PREDICATES = ("BRANCH", "CONDITION", "SCALAR_PAIR", "VARIABLE", "RETURN", "NONE", "EMPTY_STRING", "EMPTY_BYTES", "ASCII_STRING", "DIGIT_STRING", "SPECIAL_STRING", "FUNCTION_ERROR")
