import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracesift.llm import convtrie
from tracesift.llm.queries import conversation_base, conversation_head
from tracesift.operators import scan

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def said(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(convs):
    """The nodes, by walking over all prefixes."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        out[min(members), len(key)] = (
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), sum(k not in kids for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r for r in rows}


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 420), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            rows.append((c, rnd.choice([turn, turn, None]), rnd.choice(["user", "user", None]), rnd.choice(["hi", "hi", "hi", "hi", "ho", "é😀", "", None])))
    return rows


@pytest.mark.parametrize("long", [False, True])
def test_against_all_prefixes(spark, monkeypatch, long):
    if long:  # every conversation is dealt to stretches of 4 turns
        monkeypatch.setattr(scan, "has_long", lambda df, keys: 4)
        monkeypatch.setattr(scan, "LONG", 2)
        monkeypatch.setattr(convtrie, "MANY_CHILDREN", 2)
    rows = conversations(3, 60) + [(None, 1, "user", "no id"), (100, 0, "user", "base"), (100, 1, "user", "base"), (100, 1, "user", "base"), (117, 0, "x" * 50, "long " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("node", F.lit(1)).repartition(3)
    got = found(convtrie.conversation_trie(df, conversation_base(), conversation_head(), 5))
    assert got == trie(rebuilt(rows))
    if not long:
        plain = {}
        for c, turn, role, text in rows:
            if c is not None:
                plain.setdefault(c, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
        assert found(convtrie.conversation_trie(df)) == trie({c: [x[3:] for x in sorted(v)] for c, v in plain.items()})


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convtrie.conversation_trie(none).count() == 0
    # Without a base, a conversation of fewer turns than its h has none.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "hi"), (c, 1, "user", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(convtrie.conversation_trie(df, conversation_base(), conversation_head(), 5)) == {(c, 0): (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_contraction(spark):
    """Trees of several shapes in one forest."""
    rnd = random.Random(8)
    n, parent = 120, {}
    for k, shape in enumerate(("chain", "star", "caterpillar", "random", "broom")):
        at = 1000 * k
        parent[at] = None
        for i in range(1, n):
            parent[at + i] = at + {"chain": i - 1, "star": 0, "caterpillar": i - 1 if i % 2 else i - 2, "random": rnd.randrange(i), "broom": i - 1 if i < n // 2 else rnd.choice([n // 4, n // 2 - 1])}[shape]
    depth, value = {}, {i: rnd.randint(-5, 9) for i in parent}
    for i, p in parent.items():
        depth[i] = 0 if p is None else depth[p] + 1
    want = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    df = spark.createDataFrame([(i, p, depth[i], value[i]) for i, p in parent.items()], "node long, parent long, depth long, v long")
    assert {r.node: r.v for r in convtrie.subtree_totals(df, ["v"]).collect()} == want


def test_ids_of_one_node_in_many_pieces(spark):
    ends = spark.range(50_000).select(F.lit(1).alias("depth"), F.lit(2).alias("a"), F.lit(3).alias("b"), (F.col("id") * 3 - 40).alias("conv_id")).repartition(5)
    (row,) = convtrie.end_digests(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(str(3 * i - 40) for i in range(50_000)).encode()).hexdigest()
