import random
import re

import pytest
from pyspark.sql import functions as F

from tracesift.llm import jaccard
from tracesift.llm.components import components


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", low)
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def made_texts(seed, count):
    """Families of edited copies, in chains and around a centre, beside texts of their own and shared passages."""
    rnd = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(60)] + [f"rare{n}" for n in range(3000)]
    common = [rnd.choice(vocabulary[:60]) for _ in range(40)]
    texts = []
    while len(texts) < count:
        body = [rnd.choice(vocabulary if rnd.random() < 0.3 else vocabulary[:60]) for _ in range(rnd.choice([1, 2, 5, 20, 60, 120]))]
        if rnd.random() < 0.3:
            body += common
        family = rnd.choice([1, 1, 1, 2, 5, 12])
        chain = rnd.random() < 0.5
        for _ in range(family):
            texts.append(" ".join(w.upper() if rnd.random() < 0.02 else w for w in body))
            new = list(body)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                new[rnd.randrange(len(new))] = rnd.choice(vocabulary)
            if chain:
                body = new
            elif rnd.random() < 0.7:
                texts.append(" ".join(new))
    return texts[:count]


@pytest.mark.parametrize(("seed", "words", "percent", "parts"), [(1, 4, 85, 512), (2, 5, 80, 512), (3, 2, 60, 64)])
def test_against_brute_force(spark, monkeypatch, seed, words, percent, parts):
    monkeypatch.setattr(jaccard, "PARTS", parts)  # with few, sets of different sizes have different numbers of parts
    if seed == 3:  # all rounds, and shingles split
        monkeypatch.setattr(jaccard, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(jaccard, "SPLIT", 3)
    rnd = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(made_texts(seed, 220))]
    rnd.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, ""), (904, "one two"), (905, "One  two"), (None, "one two"), (None, "nobody else"), (904, "one two"), (906, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, words, percent).collect()]
    assert sorted(got, key=str) == brute(rows, words, percent)
    if seed == 1:
        return
    stay = jaccard.drop_near_copies(df, words, percent)
    assert stay.columns == df.columns
    kept = [(r.doc_id, r.text) for r in stay.collect()]
    first = {c for d, n, c in brute([r for r in rows if r[0] is not None], words, percent) if n}
    empty = [r for r in rows if not (r[1] or "").strip()]
    assert sorted(kept, key=str) == sorted([r for r in {x for x in rows if x[0] in first}] + empty + [r for r in rows if r[0] is None], key=str)


def test_links(spark):
    rows = list(enumerate(made_texts(5, 150)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, members = jaccard.jaccard_links(df, 3, 70)
    node = {r.doc_id: r.node for r in members.collect()}
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in pairs.collect()}
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[bytes(node[i])] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 20


def test_rows_that_share_an_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, "quite another text than the first of all", "b"), (1, text, "c"), (2, text.upper(), "d"), (3, text, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [(r.doc_id, r.text) for r in jaccard.drop_near_copies(df).collect()]
    assert sorted(got) == sorted([(1, text), (1, rows[1][1])])


def test_sequences_that_sums_would_confuse(spark):
    """Words, and letters in a word, in Thue-Morse order and its opposite: sums with powers of one number are equal for them."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(1, " ".join("ab"[b] for b in bits)), (2, " ".join("ba"[b] for b in bits)), (3, "".join("ab"[b] for b in bits)), (4, "".join("ba"[b] for b in bits))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_join(df, words=2048).collect()} == {1, 2, 3, 4}


def test_families_without_a_hub(spark, monkeypatch):
    """A chain of near copies, each linked with the nearest ten only, that share a passage: rounds of bands join most of it, and the
    split join the rest."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"w{i + j}" for j in range(120))) for i in range(400)]
    rows += [(10_000 + i, passage + f" alone{i} " + " ".join(f"x{i}y{j}" for j in range(8))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: 0 if i < 400 else i for i, _ in rows}
    left = {}
    for rounds in (0, 4):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "PAIRS_A_ROW", 0)
        monkeypatch.setattr(jaccard, "SPLIT", 50)
        made = jaccard._Join.cross_pairs
        monkeypatch.setattr(jaccard._Join, "cross_pairs", lambda self, crossing, made=made: left.update({rounds: crossing.where("root != main and size > 30").agg(jaccard.F.sum("n")).first()[0] or 0}) or made(self, crossing))
        assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df).collect()} == want
        monkeypatch.setattr(jaccard._Join, "cross_pairs", made)
    assert left[4] < left[0] / 2, left


def test_empty(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(7, 7), (300, 301), (301, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    for a in nodes:
        for b in nodes:
            assert (got[a] == got[b]) == (find(a) == find(b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
