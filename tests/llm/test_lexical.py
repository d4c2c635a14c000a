import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracesift.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return Counter(t.translate(lower) for t in TERM.findall(text or ""))


def ranked(docs, items, k=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=str):
        rows = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "beta", "ÉTÉ", "été", "x1", "gamma_delta", "ſ", "漢字", "K", "zeta", "eta", "theta"]
    text = lambda: rnd.choice([" ", "--", "\n", "."]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 30])))
    docs = [(i, text()) for i in range(n)]
    docs += [(d + 1000, t) for d, t in docs[: n // 2]] + [docs[3], (None, docs[4][1]), (None, "alpha"), (-5, None), (-6, "..."), (7777, "beta " * 400_000)]
    items = [(i, text()) for i in range(12)] + [(3, "alpha"), (3, "alpha"), (90, None), (91, ""), (92, "unknownword")]
    return docs, items


def test_against_every_pair(spark, monkeypatch):
    docs, items = corpus(1, 120)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1)).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = ranked(docs, items)
    got = lambda: sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, i).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 150)  # several blocks of items
    monkeypatch.setattr(lexical, "CELLS", 40)  # few classes scored at once
    monkeypatch.setattr(lexical, "_EXACT", 0)  # sums in whole numbers
    assert got() == want
    assert lexical.search(d.limit(0), i).count() == 0 and lexical.search(d, i.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_one_class_holds_most(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, f"same words {'here ' * i}") for i in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame([(1, "here"), (2, "same")], "item_id long, text string")
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, i).collect()), key=str) == ranked(docs, [(1, "here"), (2, "same")])


def test_terms_of_long_texts_in_pieces(monkeypatch):
    text = ("Abc déf-" * 50 + "x" * 90 + " Z9") * 3
    want = terms(text)
    monkeypatch.setattr(lexical, "PIECE", 16)
    assert {t.decode(): n for t, n in lexical.term_counts(text.encode()).items()} == want


def test_best_keeps_ties_by_id():
    best = lexical.Best(2, 2)
    for docs in ([9, 4], [7, 1]):
        best.add(np.array([0, 0]), np.array([5, 5]), np.array(docs), np.array([False, False]))
    assert best.doc.tolist() == [1, 4] and best.least.tolist() == [5, 1]
