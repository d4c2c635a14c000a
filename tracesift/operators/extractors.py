"""The seventeen kinds of features, each as a projection of events to observations.

An observation says that a run evaluated a feature at an event, with a truth of 1 or 0. Spectra are hit if any truth
is 1; predicates also tell runs that observed them. A feature is named by its type and key, joined by colons.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import OBSERVATION
from . import sequence

COMPARATORS = ("<", "<=", "==", ">=", ">", "!=")
EQUALITY = ("==", "!=")
CLASSES = ("0", "1", "more")
#: Other digits that count as such: superscripts, subscripts and circled ones (Unicode's type Digit).
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐"


def compare(op: Column, a: Column, b: Column) -> Column:
    """a op b as 1 or 0, op being one of COMPARATORS in a column; a null operand makes all but != false."""
    both = a.isNotNull() & b.isNotNull()
    hit = F.when(op == "<", a < b).when(op == "<=", a <= b).when(op == "==", a == b).when(op == ">=", a >= b).when(op == ">", a > b).otherwise(a != b)
    return F.when(both, hit).otherwise(op == "!=").cast("int")


def named(kind: str, key: list[str | Column], truth: Column, file2: str | None = None, line2: str | None = None) -> Column:
    """What an event says of a feature, as a struct: all of an observation but run and order."""
    name = F.concat_ws(":", F.lit(kind), "file", F.col("line").cast("string"), *[c if isinstance(c, Column) else F.col(c) for c in key])
    return F.struct(
        F.lit(kind).alias("type"), name.alias("feature"), F.col("file").alias("file"), F.col("line").cast("int").alias("line"),
        (F.col(file2) if file2 else F.lit(None).cast("string")).alias("file2"), (F.col(line2).cast("int") if line2 else F.lit(None).cast("int")).alias("line2"),
        truth.cast("int").alias("truth"),
    )


def observed(df: DataFrame, *args, **more) -> DataFrame:
    """An observation of each row; as named()."""
    return df.select("run_id", "seq", named(*args, **more).alias("o")).select("o.type", "o.feature", "o.file", "o.line", "o.file2", "o.line2", "run_id", "seq", "o.truth")


def of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def def_uses(events: DataFrame) -> DataFrame:
    found = sequence.def_use(events).withColumnsRenamed({"file": "use_file", "line": "use_line", "def_file": "file", "def_line": "line"})
    return observed(found, "DEF_USE", [F.col("use_file"), F.col("use_line").cast("string"), F.col("var")], F.lit(1), "use_file", "use_line")


def _classes(count: Column, classes: tuple[str, ...]) -> Column:
    """For each of the classes 0, 1 and more, whether the count falls into it."""
    truth = {"0": count == 0, "1": count == 1, "more": count > 1}
    return F.array(*(F.struct(F.lit(n).alias("class"), truth[n].cast("int").alias("truth")) for n in classes))


def loops(events: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    rows = sequence.loop_counts(events)
    return observed(rows.select("*", F.explode(_classes(F.col("iterations"), classes)).alias("c")), "LOOP", [F.col("c.class")], F.col("c.truth"))


def _ops(comparators: tuple[str, ...], among: tuple[str, ...] = COMPARATORS) -> Column:
    return F.array(*(F.lit(o) for o in comparators if o in among)).cast("array<string>")


def scalar_pairs(events: DataFrame, comparators: tuple[str, ...] = COMPARATORS) -> DataFrame:
    """At a DEF, the value against every visible variable of the same class; numbers, strings and bytes by all operators,
    other values of the same type by == and != of their text."""
    numeric = ("int", "float", "bool")
    seen = sequence.visible_variables(events)
    a, b = F.col("value_type"), F.col("other_value_type")
    numbers, strings, binaries = a.isin(*numeric) & b.isin(*numeric), (a == "str") & (b == "str"), (a == "bytes") & (b == "bytes")
    rows = seen.where((a == b) | numbers).select("*", F.explode(F.when(numbers | strings | binaries, _ops(comparators)).otherwise(_ops(comparators, EQUALITY))).alias("op"))
    truth = F.when(numbers, compare(F.col("op"), F.col("value_num"), F.col("other_value_num"))).when(binaries, compare(F.col("op"), F.col("value_bin"), F.col("other_value_bin"))).when(strings, compare(F.col("op"), F.col("value_str"), F.col("other_value_str")))
    same = F.col("value_str").eqNullSafe(F.col("other_value_str"))
    truth = truth.otherwise((same == (F.col("op") == "==")).cast("int"))
    return observed(rows, "SCALAR_PAIR", [F.col("var"), F.col("op"), F.col("other_var")], truth)


def _line(**_) -> Column:
    return F.array(named("LINE", [], F.lit(1)))


def _function(**_) -> Column:
    return F.array(named("FUNCTION", ["function"], F.lit(1)))


def _length(classes: tuple[str, ...] = CLASSES, **_) -> Column:
    return F.transform(_classes(F.col("length"), classes), lambda c: named("LENGTH", ["var", c["class"]], c["truth"]))


def _branch(else_side: bool = True, **_) -> Column:
    """The taken side and, if there is one, the other. A side is a then-side if its id is the smaller."""
    side = lambda own, other, truth: named("BRANCH", [F.col(own).cast("string"), F.when(F.col(own) < F.col(other), "then").otherwise("else")], F.lit(truth))
    taken = F.when(F.col("then_id") >= 0, F.array(side("then_id", "else_id", 1))).otherwise(F.array())
    return F.concat(taken, F.when(F.col("else_id") >= 0, F.array(side("else_id", "then_id", 0))).otherwise(F.array())) if else_side else taken


def _condition(**_) -> Column:
    return F.array(*(named("CONDITION", ["condition", F.lit("not" if negate else "is")], F.col("value_bool") != F.lit(negate)) for negate in (False, True)))


def _variable(comparators: tuple[str, ...] = COMPARATORS, **_) -> Column:
    made = F.transform(_ops(comparators), lambda op: named("VARIABLE", ["var", op], compare(op, F.col("value_num"), F.lit(0.0))))
    return F.when(F.col("value_type").isin("int", "float", "bool"), made).otherwise(F.array())


def _return(comparators: tuple[str, ...] = COMPARATORS, **_) -> Column:
    """Numbers against 0, strings and bytes against empty ones, all else against None."""
    kind = F.col("value_type")
    number = kind.isin("int", "float", "bool")
    against = F.when(number, "0").when(kind == "str", "''").when(kind == "bytes", "b''").otherwise("None")
    is_empty = F.when(kind == "str", F.col("value_str") == "").when(kind == "bytes", F.octet_length("value_bin") == 0).otherwise(kind.eqNullSafe("NoneType"))
    truth = lambda op: F.when(number, compare(op, F.col("value_num"), F.lit(0.0))).otherwise((F.coalesce(is_empty, F.lit(False)) == (op == "==")).cast("int"))
    ops = F.when(number, _ops(comparators)).otherwise(_ops(comparators, EQUALITY))
    return F.transform(ops, lambda op: named("RETURN", ["function", op, against], truth(op)))


def _of_def(kind: str, test: Callable[[], Column]) -> Callable[..., Column]:
    """Every DEF evaluates these, whatever its type: what isn't a string is observed as false."""
    return lambda **_: F.array(named(kind, ["var"], F.coalesce(test(), F.lit(False))))


_text = lambda: F.when(F.col("value_type") == "str", F.col("value_str"))

#: What a single event tells: the kinds of event, and an array of structs as of named().
SINGLE: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "LINE": (("LINE",), _line), "BRANCH": (("BRANCH",), _branch), "FUNCTION": (("FUNCTION_ENTER",), _function), "CONDITION": (("CONDITION",), _condition), "LENGTH": (("LEN",), _length),
    "VARIABLE": (("DEF",), _variable), "RETURN": (("FUNCTION_EXIT",), _return), "NONE": (("DEF",), _of_def("NONE", lambda: F.col("value_type") == "NoneType")),
    "EMPTY_STRING": (("DEF",), _of_def("EMPTY_STRING", lambda: _text() == "")),
    "EMPTY_BYTES": (("DEF",), _of_def("EMPTY_BYTES", lambda: (F.col("value_type") == "bytes") & (F.octet_length("value_bin") == 0))),
    "ASCII_STRING": (("DEF",), _of_def("ASCII_STRING", lambda: F.octet_length(_text()) == F.char_length(_text()))),
    "DIGIT_STRING": (("DEF",), _of_def("DIGIT_STRING", lambda: _text().rlike(rf"[\p{{Nd}}{OTHER_DIGITS}]"))),
    "SPECIAL_STRING": (("DEF",), _of_def("SPECIAL_STRING", lambda: ~_text().rlike(r"\A[\p{L}\p{N}]+\z"))),
}


def single_events(events: DataFrame, *kinds: str, **switches) -> DataFrame:
    """The observations of kinds that a single event tells, in one pass over the events."""
    told: dict[tuple[str, ...], list[Column]] = {}
    for kind in kinds:
        sources, make = SINGLE[kind]
        told.setdefault(sources, []).append(make(**switches))
    every: Column | None = None
    for sources, made in told.items():
        test = F.col("event_type").isin(*sources)
        all_of = F.concat(*made)
        every = F.when(test, all_of) if every is None else every.when(test, all_of)
    rows = of_kind(events, *{s for sources in told for s in sources})
    return rows.select("run_id", "seq", F.explode(every).alias("o")).select("o.type", "o.feature", "o.file", "o.line", "o.file2", "o.line2", "run_id", "seq", "o.truth")


def lines(events: DataFrame) -> DataFrame:
    return single_events(events, "LINE")


def branches(events: DataFrame, else_side: bool = True) -> DataFrame:
    return single_events(events, "BRANCH", else_side=else_side)


def function_errors(events: DataFrame) -> DataFrame:
    """At a function's exit or error; true for errors. Placed at the function's ENTER, if the events have one."""
    rows = of_kind(events, "FUNCTION_EXIT", "FUNCTION_ERROR")
    enters = of_kind(events, "FUNCTION_ENTER").groupBy(F.col("file").alias("_file"), F.col("function_id").alias("_id")).agg(F.min("line").alias("_line"))
    placed = rows.join(enters, (F.col("file") == F.col("_file")) & (F.col("function_id") == F.col("_id")), "left").withColumn("line", F.coalesce("_line", "line"))
    return observed(placed, "FUNCTION_ERROR", [F.col("function")], F.col("event_type") == "FUNCTION_ERROR")


#: All kinds, in the order in which features are built.
EXTRACTORS = ("LINE", "BRANCH", "FUNCTION", "LOOP", "DEF_USE", "CONDITION", "SCALAR_PAIR", "VARIABLE", "RETURN", "NONE", "EMPTY_STRING", "EMPTY_BYTES", "ASCII_STRING", "DIGIT_STRING", "SPECIAL_STRING", "LENGTH", "FUNCTION_ERROR")

#: Kinds that need the order of events or more than one of them; and the kinds of event that they need: what else a log holds is never read.
ORDERED: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "LOOP": (("LOOP_BEGIN", "LOOP_HIT", "LOOP_END"), lambda events, classes=CLASSES, **_: loops(events, classes)),
    "DEF_USE": (("DEF", "USE", "FUNCTION_ENTER", "FUNCTION_EXIT", "FUNCTION_ERROR"), lambda events, **_: def_uses(events)),
    "SCALAR_PAIR": (("DEF", "FUNCTION_ENTER", "FUNCTION_EXIT", "FUNCTION_ERROR"), lambda events, comparators=COMPARATORS, **_: scalar_pairs(events, comparators)),
    "FUNCTION_ERROR": (("FUNCTION_ENTER", "FUNCTION_EXIT", "FUNCTION_ERROR"), lambda events, **_: function_errors(events)),
}


def extract(events: DataFrame, *kinds: str, **switches) -> DataFrame:
    """The observations of several kinds (all unless given): one pass for those that single events tell, one for each other.

    switches: comparators, some of COMPARATORS, for VARIABLE, RETURN and SCALAR_PAIR; classes, some of CLASSES, for LOOP and LENGTH;
    else_side, false to leave out the side of a BRANCH that isn't taken.
    """
    kinds = kinds or EXTRACTORS
    parts = [single_events(events, *single, **switches)] if (single := [k for k in kinds if k in SINGLE]) else []
    parts += [ORDERED[k][1](of_kind(events, *ORDERED[k][0]), **switches) for k in kinds if k in ORDERED]
    out = parts[0].select(*OBSERVATION)
    for part in parts[1:]:
        out = out.unionByName(part.select(*OBSERVATION))
    return out
