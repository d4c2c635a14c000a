import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesift.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15]


def card(rnd, n=16):
    body = "4" + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def phone(rnd):
    return f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"


def corpus(rnd, n):
    """Texts with whole spans, numbers that are none, and spans that stand side by side."""
    words = ["alpha", "bé", "call", "v1.2", "3.", "2024", "x", "😀", "page 12", "id 1234567", "4.0"]
    rows = []
    for _ in range(n):
        some = [rnd.choice(words) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            some.insert(rnd.randint(0, len(some)), rnd.choice([card(rnd), phone(rnd), f"a.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com", f"{rnd.randint(1, 255)}.{rnd.randint(1, 255)}.7.{rnd.randint(1, 255)}", str(rnd.randint(10**15, 10**16))]))
        rows.append(" ".join(some))
    return rows


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(6)
    bits = ["+", "1", "12", "555", "4111", "1111", "41111111", " ", " ", "-", ".", ".", "(", ")", "@", "a", "b_", "%", "é", "😀", "\n", "255", "256", "007", "a@b.c", "x.y@d-e.fg", "10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111", "\t"]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    long = ["1 " * 30_000, "a" * 5_000 + "@", "1" * 3_000, ("." * 500 + "1") * 100, "+1" + " " * 100_000 + "x", "a@" + "b." * 30_000 + "c", "x y\n" * 20_000 + "mail a@b.cd +1 (269) 555-3296", "1.1.1.1 " * 1_000, "4111111111111111 " * 400]
    texts = [None, "", "plain", *odd, *long, *corpus(rnd, 100)]
    texts += texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit("clash")).withColumn("base", F.lit("mine")).withColumn("_text", F.lit(1)).repartition(4)
    out = pii.pii_spans(df)
    assert out.columns == ["doc_id", "text", "base", "_text", "pii"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts) and all(r.base == "mine" for r in rows.values())
    return texts, {i: [tuple(s) for s in r.pii] for i, r in rows.items()}


def test_long_runs_are_linear(spark):
    """Texts on which plain patterns would try every start of a run to its end."""
    texts = ["a" * 3_000_000 + "@", "1" * 2_000_000, "a@" + "b." * 1_000_000, "+1" + " " * 2_000_000 + "x", "x1y " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [s[:3] for s in r.pii] for r in pii.pii_spans(df, keep=["doc_id"]).collect()}
    assert got == {0: [], 1: [], 2: [("email", 0, 2_000_001)], 3: [], 4: []}


def test_fixed_spans_stay(found):
    texts, spans = found
    for i, text in enumerate(texts):
        assert [s[:3] for s in spans[i] if s[3]] == base(text or ""), text
        assert spans[i] == sorted(spans[i], key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def test_spans_side_by_side_are_added(spark):
    rnd = random.Random(7)
    joined = [f"é {phone(rnd)} {card(rnd)} end" for _ in range(40)] + [f"{card(rnd)} {card(rnd)}, ok" for _ in range(40)]
    plain = ["version 4.0 of 2024", "pages 100-200 and 300", "id 1234567, row 7654321", "at the dot of noon", "sum 1234567890123456"]
    texts = [*joined, *plain, *corpus(rnd, 600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = {r.doc_id: [tuple(s) for s in r.pii] for r in pii.pii_spans(df, keep=["doc_id"]).collect()}
    hidden = [i for i, t in enumerate(joined) if not base(t)]
    assert len(hidden) > 60
    for i in hidden:
        assert sorted(s[1:3] for s in spans[i]) == [m.span() for m in re.finditer(r"\+1 \(\d+\) 555-\d{4}|(?<!\d)4\d{15}(?!\d)", texts[i])]
    assert not any(spans[len(joined) + i] for i in range(len(plain)))
    for i in range(len(texts)):
        fixed = [s for s in spans[i] if s[3]]
        assert fixed and [s[:3] for s in fixed] == base(texts[i]) or not base(texts[i])
        assert not any(not s[3] and s[1] < f[2] and f[1] < s[2] for s in spans[i] for f in fixed)


def test_empty_table_and_no_labels(spark):
    df = spark.createDataFrame([(1, "nothing here 12")], "doc_id long, text string")
    assert [r.pii for r in pii.pii_spans(df).collect()] == [[]]
    assert pii.pii_spans(df.limit(0), keep=["doc_id"]).count() == 0


def test_trees():
    rnd = np.random.default_rng(2)
    x = rnd.integers(0, 6, (400, 4))
    y = ((x[:, 1] > 2) & (x[:, 3] <= 1)).astype(float)
    trees = pii.fit_trees(x, y, np.full(400, 3.0))
    score = sum(pii._predicted(t, x) for t in trees)
    assert ((score > 0) == (y > 0)).all()
    bound = pii.calibrated(score, y, np.ones(400))
    assert bound is not None and y[score >= bound].mean() >= pii.LEAST_PRECISION and (score >= bound).sum() >= y.sum()
    assert pii.calibrated(score, np.zeros(400), np.ones(400)) is None and pii.fit([]) == {}
