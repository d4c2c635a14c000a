import random

from tracesift.operators import threads

SCHEMA = "run_id long, thread_id long, seq long, event_type string, file string, line int, var string, var_id long, value_num double, value_str string, value_bin binary, value_type string"


class Scope:
    def __init__(self, parent=None):
        self.parent, self.known = parent, {}

    def visible(self):
        return (self.parent.visible() if self.parent else {}) | self.known


def followed(rows):
    """Scopes as objects, each thread's current one moved along the events."""
    now, root, seen, gone = {}, {}, {}, set()
    for run, thread, seq, kind, var, value in rows:
        main = now.setdefault((run, None), Scope())
        key = (run, thread)
        if key not in root:
            root[key] = now.setdefault(key, main)
        scope = now[key]
        if kind == "FUNCTION_ENTER":
            now[key] = Scope(scope)
        elif kind == "FUNCTION_EXIT" and scope is not root[key]:
            gone.add(scope)
            now[key] = scope.parent
        elif kind == "DEF":
            scope.known[var] = value
            seen[run, thread, seq] = scope.visible()
    return seen


def test_against_scope_objects(spark):
    rnd = random.Random(12)
    rows = []
    for run in range(12):
        for seq in range(1, 60):
            kind = rnd.choice(["DEF", "DEF", "DEF", "FUNCTION_ENTER", "FUNCTION_EXIT", "USE", "LINE"])
            rows.append((run, rnd.choice([None, None, 1, 2]), seq, kind, rnd.choice("abc"), float(seq)))
    df = spark.createDataFrame([(r, t, s, k, "f", 1, v, 0, x, None, None, "float") for r, t, s, k, v, x in rows], SCHEMA).repartition(3)
    want = followed([r for r in rows if r[3] != "LINE"])
    for long in (None, 8):
        got: dict = {}
        for r in threads.visible_variables(df, long).collect():
            got.setdefault((r.run_id, r.thread_id, r.seq), {})[r.other_var] = r.other_value_num
        assert got == want


def test_a_thread_that_starts_inside_a_call(spark):
    rows = [
        (None, 1, "DEF", "a"), (None, 2, "FUNCTION_ENTER", None), (None, 3, "DEF", "b"), (7, 4, "USE", "b"), (7, 5, "USE", "a"), (None, 6, "FUNCTION_EXIT", None),
        (7, 7, "FUNCTION_ENTER", None), (7, 8, "DEF", "b"), (7, 9, "USE", "b"), (7, 10, "FUNCTION_EXIT", None), (None, 11, "USE", "b"), (8, 12, "USE", "b"), (8, 13, "USE", "a"),
    ]
    df = spark.createDataFrame([(1, t, s, k, "f", 1, v, 0, 1.0, None, None, "float") for t, s, k, v in rows], SCHEMA)
    assert {(r.thread_id, r.seq): r.def_seq for r in threads.def_use(df).collect()} == {(7, 4): 3, (7, 5): 1, (7, 9): 8, (None, 11): 3, (8, 13): 1}
    scopes = {r.seq: (r.scope_thread, r.scope_id, r.depth) for r in threads.with_thread_scopes(df).collect()}
    assert scopes[4] == (None, 2, 1) and scopes[8] == (7, 7, 2) and scopes[12] == (None, 0, 0)
    assert threads.visible_variables(df.limit(0)).count() == 0
