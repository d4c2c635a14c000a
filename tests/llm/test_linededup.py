import random

import pytest
from pyspark.sql import functions as F

from tracesift.llm import linededup

BLANK = " \t\n\x0b\x0c\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, edits):
    """Places of the lines that go: equal to, or one edit from, a line that first occurs earlier."""
    first = {}
    order = [((10**18 if d is None else d, i), line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")) if line.strip(BLANK)]
    for at, line in order:
        first[line] = min(first.get(line, at), at)
    near = set()
    if edits:
        long = [t for t in first if len(t) > edits]
        for a in long:
            if any(b != a and first[b] < first[a] and within_one(a, b) for b in long):
                near.add(a)
    return {at for at, line in order if line in near or first[line] != at}


def texts(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcde fghé😀") for _ in range(n)) for n in [3, 8, 11, 12, 13, 15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300] * 3]
    out = []
    for doc in range(120):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            line = rnd.choice(base) if rnd.random() < 0.6 else "".join(rnd.choice("abcde fgh") for _ in range(rnd.randint(1, 40)))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randint(0, len(line))
                line = rnd.choice([line[:at] + rnd.choice("abz ") + line[at:], line[:at] + line[at + 1 :], line[:at] + rnd.choice("abz") + line[at + 1 :]])
            lines.append(rnd.choice([line, line, line, "", "  "]))
        out.append((doc * 3, "\n".join(lines)))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "edits"), [(1, 1), (2, 1), (3, 0), (4, 1)])
def test_against_brute_force(spark, seed, edits):
    rows = [*texts(seed), (1000, None), (1001, ""), (None, "a line of nobody's own\nshort"), (1002, "y" * 50_000 + "\n" + "y" * 50_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).repartition(5)
    gone = linededup.duplicate_lines(df, edits).collect()
    got = {(10**18 if r.doc_id is None else r.doc_id, r.line) for r in gone}
    assert got == brute(rows, edits) and len(got) == len(gone)
    for r in gone:
        own, kept = (dict(rows)[d].split("\n")[n] for d, n in ((r.doc_id, r.line), (r.kept_doc_id, r.kept_line)))
        assert own == kept if r.edits == 0 else own != kept and within_one(own, kept)
    report = {r.doc_id: r for r in linededup.line_report(df, edits).collect()}
    assert len(report) == len(rows) and report[1000].n_lines == 0 and report[1001].n_lines == 1
    assert {(10**18 if d is None else d, n) for d, r in report.items() for n in r.removed} == got


def test_rewriting(spark):
    rows = [(1, "a line that all share\nown words of one"), (2, "a line that all share\n\nown words of two"), (3, "a line that all share"), (4, ""), (5, None), (6, "A line that all share"), (None, "a line that all share"), (7, "x\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).repartition(3)
    got = linededup.dedup_lines(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "\nown words of two", 4: "", 5: None, None: "a line that all share", 7: "x"}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_sums_would_confuse(spark):
    """Thue-Morse lines that differ at every place: sums with powers of one number are equal for them."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    df = spark.createDataFrame([(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))], "doc_id long, text string")
    assert linededup.duplicate_lines(df).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(0, "a line that all share"), (1, "own words\na line that all share"), (1, "other words of mine\nand more of them"), (2, "and more of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("Places", F.lit(1))
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == [(0, rows[0][1]), (1, rows[2][1]), (1, "own words")]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same line of text here"), (1, "same line of text here"), (2, "same line of text here")], "doc_id long, text string")
    assert [(r.doc_id, r.line) for r in linededup.duplicate_lines(df).collect()] == [(2, 0)]


def test_one_text_of_very_many_lines(spark):
    """Rewriting splits a text once: its time grows with the text, not with its square."""
    import time

    lines = [f"line number {i % 70_000} of a table" for i in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "another\nline number 7 of a table")], "doc_id long, text string")
    linededup.dedup_lines(df.limit(1), max_edits=0).collect()
    start = time.time()
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, max_edits=0).collect()}
    assert time.time() - start < 20
    assert got == {1: "\n".join(lines[:70_000]), 2: "another"}


def test_broadcast_by_bytes(spark):
    from tracesift.llm import common

    few = spark.range(1000).select(F.col("id"), F.array(F.lit("x")).alias("names"), F.struct(F.lit("abc").alias("t")).alias("s"))
    assert "broadcast" in common.broadcast_small(few)._jdf.queryExecution().logical().toString().lower()
    wide = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert "broadcast" not in common.broadcast_small(wide)._jdf.queryExecution().logical().toString().lower()
    assert common.broadcast_small(few.limit(0)).count() == 0
