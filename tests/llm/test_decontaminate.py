import random

import numpy as np
import pyarrow as pa
import pytest

from tracesift.llm import decontaminate as D

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "pra", "vel", "do") for b in ("n", "ra", "st", "mo", "li", "x", "ge", "u")]


def least_edits(item, part):
    before = [0] * (len(part) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(part, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def edited(rnd, words, count):
    words = list(words)
    for _ in range(count):
        at = rnd.randrange(len(words))
        kind = rnd.random()
        if kind < 0.6:
            words[at] = rnd.choice(WORDS)
        elif kind < 0.8:
            words.insert(at, rnd.choice(WORDS))
        else:
            words.pop(at)
    return words


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        item = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 40))]
        part = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 60))]
        assert D.edits_within(np.array(item, dtype=np.uint64), np.array(part, dtype=np.uint64))[0] == least_edits(item, part)


def test_against_brute_force():
    rnd = random.Random(2)
    items = [(n, " ".join(rnd.choice(WORDS) for _ in range(size))) for n, size in enumerate([1, 3, 6, 10, 14, 15, 20, 30, 45, 60, 90] * 2)]
    texts = []
    for _ in range(300):
        body = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 150))]
        if rnd.random() < 0.6:
            _, text = rnd.choice(items)
            words = text.split()
            at = rnd.randint(0, len(body))
            body[at:at] = edited(rnd, words, rnd.randint(0, len(words) * 15 // 100))
        texts.append(" ".join(w.capitalize() if rnd.random() < 0.1 else w + "," * (rnd.random() < 0.1) for w in body))
    want = set()
    for i, text in enumerate(texts):
        words = D.words_of(text).tolist()
        for n, item in items:
            own = D.words_of(item).tolist()
            if least_edits(own, words) <= len(own) * D.EDIT_PERCENT // 100:
                want.add((i, n))
    got = {(i, x["item_id"]) for i, found in enumerate(D.leaks_in(D.build_index(items), pa.array(texts))) for x in found}
    assert got <= want  # every one is verified
    assert len(got) >= 0.97 * len(want)  # and few are missed


@pytest.mark.parametrize("chars", [D.BLOCK_CHARS, 50])
def test_defined_cases(spark, monkeypatch, chars):
    monkeypatch.setattr(D, "BLOCK_CHARS", chars)
    item = " ".join(WORDS[:20])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "so " + item.upper() + "!"), (3, "so " + item.upper() + "!"), (4, "x " * 50_000 + item), (None, item)], "doc_id long, text string").withColumn("leaks", D.F.lit("clash"))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item), (None, item)], "item_id long, text string")
    found = [(r.doc_id, sorted((x.item_id or -1) for x in r.leaks)) for r in D.find_leaks(df, bench).collect()]
    assert sorted(found, key=str) == sorted([(1, []), (2, []), (3, [-1, 7, 7]), (3, [-1, 7, 7]), (4, [-1, 7, 7]), (None, [-1, 7, 7])], key=str)
    assert all(r.leaks == [] for r in D.find_leaks(df, bench.limit(0)).collect())
    assert D.find_leaks(df.limit(0), bench).count() == 0


def test_joined_like_broadcast(spark, monkeypatch):
    """A benchmark over the bound is joined, with the same result; short items, repeated ones and repeated documents among them."""
    rnd = random.Random(7)
    items = [(n, " ".join(rnd.choice(WORDS) for _ in range(size))) for n, size in enumerate([1, 2, 3, 5, 8, 9, 14, 16, 23, 40, 80] * 2)]
    items += [(n + 100, text) for n, text in items[:8]]
    texts = []
    for _ in range(120):
        body = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 60))]
        words = rnd.choice(items)[1].split()
        body[5:5] = edited(rnd, words, rnd.randint(0, len(words) // 5))
        texts.append(" ".join(body))
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts + texts[:5])], "doc_id long, text string, of int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    both = []
    for chars in (D.BLOCK_CHARS, 200):
        monkeypatch.setattr(D, "BLOCK_CHARS", chars)
        got = D.find_leaks(df, bench)
        assert got.columns == [*df.columns, "leaks"]
        both.append({r.doc_id: sorted(map(tuple, r.leaks)) for r in got.collect()})
    assert both[0] == both[1] and len(both[0]) == 125


def test_ties(spark):
    """Of two equal places the first, of a worse and a better one the better."""
    item = WORDS[:20]
    broken = ["other", *item[1:]]
    text = " ".join([*broken, *WORDS[30:40], *item, *WORDS[30:40], *item])
    leak = D.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).first().leaks[0]
    assert (leak.edits, leak.first_word) == (0, 30)


def test_recall_of_each_length():
    """With all the edits that are allowed, at every length from 1 to 64."""
    vocabulary = [f"w{n}" for n in range(5000)]
    for size in range(1, 65):
        rnd = random.Random(size)
        items = [(n, " ".join(rnd.choice(vocabulary) for _ in range(size))) for n in range(150)]
        texts = []
        for _, text in items:
            body = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 80))]
            at = rnd.randint(0, len(body))
            body[at:at] = edited(rnd, text.split(), size * D.EDIT_PERCENT // 100)
            texts.append(" ".join(body))
        found = D.leaks_in(D.build_index(items), pa.array(texts))
        assert sum(any(x["item_id"] == n for x in leaks) for n, leaks in enumerate(found)) >= 0.9 * len(items), size
