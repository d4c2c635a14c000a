"""Conversation prefix trie: what conversations share from their first turn on, and totals of every subtree.

A node is a distinct sequence of first turns. It is told by the exclusive or of 120 bits of its turns' SHA-256 digests, each with its
place, which a running aggregate gives to all turns at once; a node is named by its depth and its smallest conversation.

Subtree totals come from parallel tree contraction. Rounds alternate: rake takes away all leaves and adds their totals to their
parents; compress cuts out nodes with one child, no two of them adjacent, whose child hangs from their parent then. The first rounds
cut nodes by the bits of their depth, which halves a chain each time, later ones by a hash. Nodes cut out get their totals when the
contraction is undone, from the last round to the first, each from the child that took its place.

No step gathers a node's children or members: counts and sums are partly aggregated before they are shuffled, children find their
parents by a join in which parents of many children are broadcast, and the ids of conversations that end at a node are dealt by
ranges, written as pieces of text, and hashed piece by piece.

Defined cases: rows without conv_id take no part; a null role or text is empty; null turns come first, and turns of one number are
ordered by the digest of role and text; repeated rows are turns of their own; an empty table has no nodes; other columns are ignored.
Conversations without turns are members of the root. Texts of any length take part as digest and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from .common import drop_stored, stored, text_batches
from .components import tasks_for

KEY = ["depth", "a", "b"]
#: Parents that are broadcast have more children than this, and than a thousandth of all nodes: a thousand parents at most.
MANY_CHILDREN = 10_000


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, said (the SHA-256 of role and text) and chars, the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.where("conv_id is not null").select("conv_id", "turn", said.alias("said"), F.length(text).cast("long").alias("chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """Adds depth, a turn's place from 1."""
    return scan.running(turns, ["conv_id"], "turn", [F.col("turn").asc_nulls_first(), "said"], {"depth": ("sum", F.lit(1))})


def grafted(turns: DataFrame, base: Column, kept: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of which each conversation's first ``kept`` (``most`` at most) are replaced by those of its base.

    Returns the new turns and the conversations with their number of turns (conv_id, n_turns). base and kept are functions of conv_id.
    """
    ids = turns.groupBy("conv_id").agg(F.max("depth").alias("n")).select("conv_id", "n", base.alias("base"), kept.alias("h"))
    ids = stored(ids, "conversations")
    heads = turns.where(F.col("depth") <= most).select(F.col("conv_id").alias("base"), F.col("depth").alias("place"), "said", "chars")
    lengths = ids.select(F.col("conv_id").alias("base"), F.least("n", F.lit(most)).alias("base_n"))
    ids = ids.join(lengths, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    first = ids.join(heads, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "said", "chars")
    # A conversation meets its row once for every LONG turns, so that a long one is no single key.
    piece = lambda c: F.floor((F.col(c) - 1) / scan.LONG)
    parts = ids.where("n > h").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), piece("n"))).alias("piece"))
    rest = turns.withColumn("piece", piece("depth")).join(parts, ["conv_id", "piece"]).where("depth > h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("depth") - F.col("h")).alias("depth"), "said", "chars")
    return first.unionByName(rest), ids.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n_turns"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, chars, the key of the sequence up to the turn (a, b) and up to the one before (pa, pb)."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("said")).cast("binary"), 256)
    parts = turns.select("conv_id", "depth", "chars", digest.alias("d")).select("conv_id", "depth", "chars", *(F.conv(F.substring("d", at, 15), 16, 10).cast("long").alias(n) for n, at in (("x", 1), ("y", 16))))
    rows = scan.running(parts, ["conv_id"], "depth", [F.col("depth")], {"a": ("xor", F.col("x")), "b": ("xor", F.col("y"))})
    return rows.select("conv_id", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, parent and parent_conv_id (null for the root)."""
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    counts = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where("n_children > 0").select("n_children", (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    many = F.col("n_children") > max(MANY_CHILDREN, nodes.count() // 1000)
    on = ["depth", "pa", "pb"]
    hot = nodes.join(F.broadcast(parents.where(many).drop("n_children")), on, "left")
    columns = [*nodes.columns, "parent", "parent_conv_id"]
    other = hot.where("parent is null").select(*nodes.columns).join(parents.where(~many).drop("n_children"), on, "left")
    return hot.where("parent is not null").select(*columns).unionByName(other.select(*columns))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """node and, for each of the values, its sum over the node and all below. tree: node, parent (null for roots), depth, values."""
    live = tree.select("node", "parent", "depth", *values, *(F.lit(0).cast("long").alias(f"up_{v}") for v in values))
    marks: list[DataFrame] = []
    cuts: list[DataFrame] = []
    old: list[DataFrame] = []
    left = None
    while True:
        kids = live.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.lit(True).alias("inner"))
        marked = live.join(kids, "node", "left").withColumn("inner", F.col("inner").isNotNull())
        marked = stored(marked if left is None else marked.coalesce(tasks_for(left)), "marked")
        drop_stored(*old)
        marks.append(marked)
        inner = marked.where("inner")
        found = inner.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
        if not (left := found.n):
            break
        # Rake: leaves go, and their parents take over their totals.
        raked = marked.where("not inner").groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"add_{v}") for v in values))
        heirs = inner.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_inner"), F.min("node").alias("heir"))
        rest = inner.join(raked, "node", "left").join(heirs, "node", "left")
        k = len(cuts)
        coin = F.shiftright("depth", k).bitwiseAND(1) == 1 if 1 << k <= found.deepest else F.xxhash64("node", F.lit(k)).bitwiseAND(1) == 1
        rest = rest.select("node", "parent", "depth", *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values), *(f"up_{v}" for v in values), "heir", (F.coalesce("n_inner", F.lit(0)) == 1).alias("single"))
        rest = stored(rest.withColumn("heads", F.col("single") & F.col("parent").isNotNull() & coin).coalesce(tasks_for(left)), "rest")
        # Compress: of adjacent nodes with one child, one at most is cut.
        below = rest.where("not heads").select(F.col("node").alias("heir"), *(F.col(f"up_{v}").alias(f"over_{v}") for v in values))
        cut = stored(rest.where("heads").join(below, "heir").coalesce(tasks_for(left)), "cut")
        cuts.append(cut)
        lifted = cut.select(F.col("heir").alias("node"), F.col("parent").alias("to"), *((F.col(v) + F.col(f"up_{v}")).alias(f"more_{v}") for v in values))
        live = rest.join(cut.select("node"), "node", "left_anti").join(lifted, "node", "left")
        live = live.select("node", F.coalesce("to", "parent").alias("parent"), "depth", *values, *((F.col(f"up_{v}") + F.coalesce(f"more_{v}", F.lit(0))).alias(f"up_{v}") for v in values))
        old = [rest]
    known = None  # every node cut out, the raked node that its total comes from, and what is to be added
    for cut in reversed(cuts):
        step = cut.select("node", F.col("heir").alias("to"), *((F.col(v) + F.col(f"over_{v}")).alias(v) for v in values))
        if known is not None:
            later = known.select(F.col("node").alias("to"), F.col("to").alias("end"), *(F.col(v).alias(f"add_{v}") for v in values))
            moved = step.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"), *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values))
            last, known = known, stored(moved.unionByName(known), "known")
            drop_stored(last)
        else:
            known = step
    total = marks[0].where("not inner").select("node", *values)
    for marked in marks[1:]:
        total = total.unionByName(marked.where("not inner").select("node", *values))
    if known is not None:
        ends = total.select(F.col("node").alias("to"), *(F.col(v).alias(f"add_{v}") for v in values))
        total = total.unionByName(known.join(ends, "to").select("node", *((F.col(v) + F.col(f"add_{v}")).alias(v) for v in values)))
    total = stored(total, "totals")
    drop_stored(known, *marks, *cuts)
    return total


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, a, b, conv_id) to a piece per key and batch: its first id, and its ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = np.concatenate([[0], new]).astype(np.int32)
        offsets = np.concatenate([starts, [batch.num_rows]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pc.cast(batch.column(3), pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(starts)) for i in range(4)), pc.binary_join(lists, ",")], names=[*KEY, "first", "ids"])


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id, to one digest per key. Only the state of the hash is kept from piece to piece."""
    names = [*KEY, "ends_sha256"]
    now, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for key, ids in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(3).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256: the SHA-256 of the conv_ids of each key's rows, ascending, joined by commas."""
    text_batches(ends.sparkSession)
    key = "depth long, a long, b long"
    dealt = stored(ends.select(*(F.col(c).cast("long").alias(c) for c in KEY), F.col("conv_id").cast("long").alias("conv_id")), "ends").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = dealt.mapInArrow(_joined_ids, f"{key}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(_hashed_pieces, f"{key}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth from 1 without gaps, said, chars; conversations: conv_id, n_turns, a row each.
    n_leaves and saved_tokens are totals of the subtree: childless nodes, and each node's (n_convs - 1) x chars of its last turn.
    """
    paths = stored(_prefixes(turns), "paths")
    zero = F.lit(0).cast("long")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("chars"), zero.alias("pa"), zero.alias("pb"))
    nodes = stored(nodes.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = stored(_with_parents(nodes), "nodes")
    tree = nodes.select("node", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("k")).select("conv_id", "k.*")
    bare = conversations.where("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    ends = end_digests(last.unionByName(bare))
    both = nodes.join(totals, "node").join(ends, KEY, "left")
    long = lambda c: F.col(c).cast("long").alias(c)
    return both.select("conv_id", long("depth"), "parent_conv_id", long("n_convs"), long("n_children"), long("n_leaves"), long("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column | None = None, kept: Column | None = None, most: int = 0) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); with base and kept, of its grafted conversations."""
    turns = stored(numbered(turn_digests(conversations)), "turns")
    turns, ids = grafted(turns, F.col("conv_id") if base is None else base, F.lit(0).cast("long") if kept is None else kept, most)
    return prefix_trie(stored(turns, "turns"), stored(ids, "conversations"))
