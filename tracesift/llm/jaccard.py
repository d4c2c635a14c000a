"""N-gram Jaccard join: which texts share enough word shingles, and what hangs together by such links.

Words are runs of bytes other than white space, A-Z lower-cased; a text's set holds its distinct shingles of
``words`` words, or its whole word sequence if that is shorter. Two texts link if 100 * |intersection| >=
percent * |union|. Texts of the same word sequence are one node, named by a 128-bit digest.

Order: occurrences of all shingles of the corpus are counted into a table of 2^22 counters, and those of all words, none of
which a shingle can outnumber, into one of 2^20; the tables' sizes are fixed. Shingles are ordered by the least of the
counts of themselves and their words, then by hash. Rare ones come first, and passages that many texts share last.

Candidates: two sets that link share a shingle within their prefixes in that order, where a set of n has a prefix
of n - ceil(n * percent / 100) + 1. Prefix shingles are the join's keys. Three filters prune pairs inside the join: lengths;
positions; and suffixes. The last is a division of all shingles into parts by hash, where a node carries for each part whether
it holds an odd number; parts in which two nodes differ bound from below in how many shingles they differ.

jaccard_join() finds components, for which not all pairs of a shingle's texts are needed. First each node meets hubs only: of
each prefix shingle's nodes the one that has it furthest in front, and so the fewest rare shingles of its own. The hub nearest by the
suffix filter is verified. Nodes that link make components. What is left are shingles whose nodes lie in different
components. While their nodes would meet in many pairs, there are more rounds of hubs: of the nodes whose shingles have the same
two least hashes one is met by the rest, with other hashes each round, so that families without a common hub grow together. In
the end each node outside a shingle's largest component meets all nodes of other components that pass the filters, where shingles
of many nodes are split over parts. So a group of copies costs as much as its size, and no pair that could join two components
goes unseen.
jaccard_links() returns all links between nodes instead, from the same join without hubs; it grows with the links there are.

Verification: pairs are distinct, and each is verified once. Only texts of such pairs are read again for their whole sets. A suffix
filter on them divides what follows the first common shingle at shingles of one of them and compares the parts' sizes;
what passes is intersected exactly.

Defined cases: a text that is null or without words has the size 0 and links with nothing, not even its likes.
Rows that repeat a text link with each other. Rows with a null id belong to components, whose id is the smallest
that isn't null; a component of null ids only has a null id. All other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import SLICE_BYTES, chained, digest, lower_ascii, space_bytes, text_buffers, word_hashes
from .common import broadcast_small, drop_stored, fresh, list_array, slices, stored, text_batches
from .components import components, tasks_for
from .sketches import whole_table

WORDS, PERCENT = 5, 80
#: Counters of words and of shingles, as powers of two.
WORD_BITS, SHINGLE_BITS = 20, 22
#: The least number of parts of the suffix filter; larger sets have as many as shingles, rounded up to a power of two.
PARTS = 512
#: Pairs of whole sets that a task compares, and row keys that are broadcast (16 bytes each); more are joined by a shuffle.
PAIRS_EACH, KEYS_BROADCAST = 4_000, 1_000_000
#: Rounds of hubs by bands at most; while pairs that nodes of different components would meet in are more than so many a row, and while a
#: round finds a link for every so many rows. These only decide how much is left to the last join, which finds the rest.
ROUNDS, PAIRS_A_ROW, ROWS_A_LINK = 8, 20, 1_000
#: Nodes of a shingle that others meet in one part of the last join.
SPLIT = 2_000


def words_in(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first and last row, the hashes of all words, each row's first word."""
    data, offsets = text_buffers(column)
    lower, space = lower_ascii(), space_bytes()
    for a, b in slices(np.maximum(np.diff(offsets), 1), SLICE_BYTES):
        part = lower[data[offsets[a] : offsets[b]]]
        hashes, _, _, first = word_hashes(part, offsets[a : b + 1] - offsets[a], space)
        yield a, b, hashes, first


def nodes_in(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A digest of each text's word sequence."""
    return [digest(hashes[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def shingles_in(hashes: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each shingle in a slice its text, first word and hash."""
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    start = np.repeat(first[:-1] - np.cumsum(count) + count, count) + np.arange(len(text))
    levels = chained(hashes, words)
    made = levels[-1][start]
    for k in range(1, words):  # short texts
        some = n[text] == k
        made[some] = levels[k - 1][start[some]]
    return text, start, made


def sets_in(hashes: np.ndarray, first: np.ndarray, rarity: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text in a slice the size of its set, and the sets, one after another, each in order: the rarity
    in the top byte, then the hash."""
    text, start, made = shingles_in(hashes, first, words)
    common = rarity[(1 << WORD_BITS) + (made >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64)]
    per_word = rarity[(hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)]
    end = np.minimum(start + words, first[1:][text]) - 1
    for k in range(words):
        np.minimum(common, per_word[np.minimum(start + k, end)], out=common)
    grams = (common.astype(np.uint64) << np.uint64(56)) | (made >> np.uint64(8))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return np.bincount(text, minlength=len(first) - 1), grams


def rarities(texts: DataFrame, words: int) -> np.ndarray:
    """For each counter of words, then of shingles, how common they are: 8 times the binary logarithm, in a byte."""

    def count(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, _, hashes, first in words_in(batch.column(0)):
            table[: 1 << WORD_BITS] += np.bincount((hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS).astype(table.dtype)
            at, times = np.unique((shingles_in(hashes, first, words)[2] >> np.uint64(64 - SHINGLE_BITS)).astype(np.int64), return_counts=True)
            table[(1 << WORD_BITS) + at] += times.astype(table.dtype)

    counts = whole_table(texts, count, (1 << WORD_BITS) + (1 << SHINGLE_BITS))
    return np.minimum(np.log2(np.maximum(counts, 1)) * 8, 255).astype(np.uint8)


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - (size * percent + 99) // 100 + 1, 0)


def odd_parts(grams: np.ndarray) -> np.ndarray:
    """Of a set, for each part whether it holds an odd number of shingles: bits, in 64-bit words."""
    parts = max(PARTS, 1 << max(len(grams) - 1, 0).bit_length())
    odd = np.bincount((grams & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_overlap(size_a: int, size_b: int, percent: int) -> int:
    """What two sets of these sizes must share to link."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """In how many elements two ordered sets differ at least: divided at seven elements of y, each part by its sizes."""
    cuts = y[np.arange(1, 8) * len(y) // 8]
    both = [np.diff(np.searchsorted(s, cuts), prepend=0, append=len(s)) for s in (x, y)]
    return int(np.abs(both[0] - both[1]).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ordered sets link."""
    need = least_overlap(len(x), len(y), percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y) > len(x) + len(y) - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _key(text: Column | str = "text") -> Column:
    """Tells rows apart; only repeated rows share it."""
    return F.xxhash64("doc_id", text)


class _Join:
    """The state of one join: the rarity table, a row per document, and prefix shingles that nodes share."""

    def __init__(self, df: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.spark, self.words, self.percent = df.sparkSession, words, percent
        text_batches(self.spark)
        self.texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.rarity = self.spark.sparkContext.broadcast(rarities(df.select(text_col), words))
        self.docs = stored(self._prefixes(), "prefixes")
        self.shared = stored(self._shared(), "shared")
        self.nodes = stored(self._nodes(), "nodes")

    def _prefixes(self) -> DataFrame:
        rarity, words, percent = self.rarity, self.words, self.percent

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()  # nodes of this task: a copy needn't repeat what its node has
            for batch in batches:
                for a, b, hashes, first in words_in(batch.column(2)):
                    nodes = nodes_in(hashes, first)
                    size, grams = sets_in(hashes, first, rarity.value, words)
                    new = size > 0
                    for i, node in enumerate(nodes):
                        if node in seen:
                            new[i] = False
                        else:
                            seen.add(node)
                    keep = np.where(new, prefix_size(size, percent), 0)
                    at = np.cumsum(size) - size
                    inside = np.arange(len(grams)) - np.repeat(at, size) < np.repeat(keep, size)
                    odd = [odd_parts(grams[at[i] : at[i] + size[i]]) if new[i] else None for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(nodes, pa.binary()), pa.array(size.astype(np.int32)),
                        list_array(grams[inside].view(np.int64), keep, pa.int64()), pa.array(odd, pa.list_(pa.int64())),
                    ], names=["doc_id", "key", "node", "size", "grams", "odd"])
                    if len(seen) > 500_000:
                        seen.clear()

        return self.texts.select("doc_id", _key().alias("key"), "text").mapInArrow(prefixes, "doc_id long, key long, node binary, size int, grams array<long>, odd array<long>")

    def _shared(self) -> DataFrame:
        """gram, node, size, pos: prefix shingles that several nodes of suitable lengths have."""
        nodes = self.docs.where("size > 0 and size(grams) > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))
        rows = nodes.select("node", "size", F.posexplode("grams").alias("pos", "gram"))
        order = Window.partitionBy("gram").orderBy("size", "node")
        rows = rows.withColumn("less", F.lag("size").over(order)).withColumn("more", F.lead("size").over(order))
        return rows.where((100 * F.col("less") >= self.percent * F.col("size")) | (100 * F.col("size") >= self.percent * F.col("more"))).select("gram", "node", "size", "pos")

    def _nodes(self) -> DataFrame:
        """node, key of one of its rows, odd, and half, odd for half as many parts: nodes that have shared prefix shingles."""
        some = self.shared.select("node").distinct()
        made = self.docs.where("size(grams) > 0").join(some, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"), F.first("odd").alias("odd"))
        parts = F.size("odd").cast("int") / 2
        half = F.zip_with(F.slice("odd", 1, parts.cast("int")), F.slice("odd", (parts + 1).cast("int"), parts.cast("int")), lambda x, y: x.bitwiseXOR(y))
        return made.select("node", "key", "odd", half.alias("half"))

    def fits(self) -> Column:
        """By length; and by position: what precedes a common shingle in the shorter prefix, it, and what follows it."""
        low, high, total = F.least("size", "other_size"), F.greatest("size", "other_size"), F.col("size") + F.col("other_size")
        reach = F.least("pos", "other_pos") + F.least(F.col("size") - F.col("pos"), F.col("other_size") - F.col("other_pos"))
        return (100 * low >= self.percent * high) & (reach >= F.ceil(F.lit(self.percent) * total / (100 + self.percent)))

    def differ(self) -> Column:
        """In how many shingles two nodes differ at least."""
        a, b = F.size("odd"), F.size("other_odd")
        x, y = F.when(a > b, F.col("half")).otherwise(F.col("odd")), F.when(b > a, F.col("other_half")).otherwise(F.col("other_odd"))
        count = F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, n: s + n)
        return F.when(F.size(x) == F.size(y), count).otherwise(0)

    def near(self) -> Column:
        """By suffix: what may differ."""
        total = F.col("size") + F.col("other_size")
        return self.differ() <= total - 2 * F.ceil(F.lit(self.percent) * total / (100 + self.percent))

    def other(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({c: f"other_{c}" for c in rows.columns if c not in ("gram", "part")})

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored distinct pairs (a, b) that link."""
        rarity, words, percent = self.rarity, self.words, self.percent
        count = pairs.count()
        if not count:
            return pairs
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stored(self.nodes.join(ends, "node", "left_semi").select(F.col("key").alias("wanted")), "wanted")
        rows = self.texts.where("text is not null")
        few = F.broadcast(wanted) if wanted.count() <= KEYS_BROADCAST else wanted
        rows = rows.join(few, _key() == F.col("wanted"), "left_semi").select("text")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, hashes, first in words_in(batch.column(0)):
                    size, grams = sets_in(hashes, first, rarity.value, words)
                    at = np.cumsum(size) - size
                    yield pa.RecordBatch.from_arrays([pa.array(nodes_in(hashes, first), pa.binary()), pa.array([grams[i : i + n].tobytes() for i, n in zip(at, size, strict=True)], pa.binary())], names=["node", "grams"])

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [linked(*(np.frombuffer(s.as_buffer(), dtype="<u8") for s in both), percent) for both in zip(batch.column(2), batch.column(3), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        found = stored(rows.mapInArrow(sets, "node binary, grams binary"), "sets")
        side = lambda x: found.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "grams_a", "grams_b")
        if (tasks := tasks_for(count, PAIRS_EACH)) < 8:
            full = full.coalesce(tasks)
        out = stored(full.mapInArrow(test, "a binary, b binary").distinct().coalesce(tasks_for(count)), "links")
        drop_stored(found, wanted)
        return out

    def few(self, table: DataFrame) -> DataFrame:
        """A stored table of nodes, to be broadcast if it is small in bytes."""
        return broadcast_small(table)

    def candidates(self, rows: DataFrame, others: DataFrame, extra: Column, on: tuple[str, ...] = ("gram",)) -> DataFrame:
        """Distinct pairs (a, b) of rows and others (columns other_...) that share a shingle and pass all filters."""
        odd = self.few(self.nodes.select("node", "odd", "half"))
        other_odd = self.few(self.other(self.nodes.select("node", "odd", "half")))
        both = rows.join(odd, "node").join(others.join(other_odd, "other_node"), list(on)).where(extra & self.fits() & self.near())
        return both.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()

    def hub_pairs(self) -> DataFrame:
        """For each node the nearest of its hubs."""
        at = F.struct("pos", F.xxhash64("node").alias("h"), F.col("node").alias("other_node"), F.col("size").alias("other_size"))
        hubs = self.shared.groupBy("gram").agg(F.min(at).alias("hub")).select("gram", F.col("hub.pos").alias("other_pos"), "hub.other_node", "hub.other_size")
        met = self.shared.join(hubs, "gram").where((F.col("node") != F.col("other_node")) & self.fits())
        met = met.groupBy("node", "other_node").agg(F.first("size").alias("size"), F.first("other_size").alias("other_size"))
        odd = self.nodes.select("node", "odd", "half")
        met = met.join(self.few(odd), "node").join(self.few(self.other(odd)), "other_node").where(self.near())
        best = met.groupBy("node").agg(F.min_by("other_node", F.struct(self.differ().alias("d"), "other_node")).alias("other"))
        return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def crossing(self, roots: DataFrame) -> DataFrame:
        """gram, node, size, pos and root of the shingles whose nodes lie in different components; main, the largest of these; n, the
        shingle's nodes; and outside, those that aren't in main."""
        rows = self.shared.join(self.few(roots), "node", "left").select("gram", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
        each = rows.groupBy("gram", "root").agg(F.count("*").alias("n"))
        per = each.groupBy("gram").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
        per = stored(per.select("gram", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("outside")), "several")
        out = stored(rows.join(self.few(per), "gram"), "crossing")
        drop_stored(per)
        return out

    def band_pairs(self, crossing: DataFrame, turn: int) -> DataFrame:
        """Each node of crossing shingles, and one of those that have the same least two of these shingles by the turn's hashes."""
        least = lambda k: F.min(F.xxhash64("gram", F.lit(2 * turn + k)))
        nodes = stored(crossing.groupBy("node").agg(F.first("size").alias("size"), F.first("root").alias("root"), least(0).alias("one"), least(1).alias("two")), "bands")
        hubs = nodes.groupBy("one", "two").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "root")).alias("hub"))
        hubs = hubs.select("one", "two", *(F.col(f"hub.{c}").alias(f"other_{c}") for c in ("node", "size", "root")))
        low, high = F.least("size", "other_size"), F.greatest("size", "other_size")
        met = nodes.join(hubs, ["one", "two"]).where((F.col("root") != F.col("other_root")) & (100 * low >= self.percent * high))
        odd = self.nodes.select("node", "odd", "half")
        met = met.join(self.few(odd), "node").join(self.few(self.other(odd)), "other_node").where(self.near())
        out = stored(met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct(), "pairs")
        drop_stored(nodes)
        return out

    def cross_pairs(self, crossing: DataFrame) -> DataFrame:
        """Pairs of nodes of different components, each of which may link. A shingle of many nodes is split: the nodes that others
        meet are dealt to parts of some SPLIT, and each that meets them goes to every part."""
        parts = F.ceil(F.col("n") / SPLIT).cast("int")
        rows = crossing.where("root != main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("gram", "part", "node", "size", "pos", "root")
        others = crossing.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).select("gram", "part", "node", "size", "pos", "root", "main")
        # Of two nodes outside the main component one meets the other only.
        apart = (F.col("root") != F.col("other_root")) & ((F.col("other_root") == F.col("other_main")) | (F.col("node") < F.col("other_node")))
        return self.candidates(rows, self.other(others), apart, ("gram", "part"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components once links between them have been added; the old table goes."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    out = stored(moved.unionByName(joined.join(roots, "node", "left_anti")), "roots")
    drop_stored(joined, roots)
    return out


def _components(join: _Join) -> DataFrame:
    """node, root for nodes that link with others."""
    pairs = stored(join.hub_pairs(), "pairs")
    links = join.verified(pairs)
    roots = components(links)
    drop_stored(pairs, links)
    crossing = join.crossing(roots)
    for turn in range(ROUNDS):
        cost = crossing.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("root") != F.col("main"), F.col("n"))).alias("pairs")).first()
        if (cost.pairs or 0) <= PAIRS_A_ROW * cost.rows:
            break
        pairs = join.band_pairs(crossing, turn)
        links = join.verified(pairs)
        if links is pairs or not (found := links.count()):
            drop_stored(pairs)
            break
        old, roots = crossing, _merged(roots, links)
        crossing = join.crossing(roots)
        drop_stored(pairs, links, old)
        if found * ROWS_A_LINK < cost.rows:
            break
    cross = stored(join.cross_pairs(crossing), "cross")
    links = join.verified(cross)
    if links is not cross:
        roots = _merged(roots, links)
        drop_stored(links)
    drop_stored(cross, crossing)
    return roots


def _named(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, node and size for every row of df, the node null for sizes of 0; and node, root of nodes that link with others."""
    join = _Join(df, words, percent, id_col, text_col)
    roots = _components(join)
    docs = join.docs.select("doc_id", "key", F.when(F.col("size") > 0, F.col("node")).alias("node"), "size")
    drop_stored(join.shared, join.nodes)
    return docs, roots


def jaccard_join(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of df."""
    docs, roots = _named(df, words, percent, id_col, text_col)
    # The least id of a node, then of a component; copies are put together before they are sent.
    least = docs.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select("node", "component_id")
    out = docs.join(named, "node", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_links(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of different nodes that link; and doc_id, node for every row of df, null for texts without words."""
    join = _Join(df, words, percent, id_col, text_col)
    pairs = stored(join.candidates(join.shared, join.other(join.shared), F.col("node") < F.col("other_node")), "pairs")
    return join.verified(pairs), join.docs.select("doc_id", F.when(F.col("size") > 0, F.col("node")).alias("node"))


def drop_near_copies(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component: that with the smallest id, then the smallest hash of id and text. Rows that share an
    id but not a component all stay. Of rows that repeat both id and text one stays. Rows without words, or without an id, stay."""
    some = df.where(F.col(id_col).isNotNull())
    docs, roots = _named(some, words, percent, id_col, text_col)
    rows = docs.where("size > 0").groupBy("node", "doc_id", "key").agg(F.count("*").alias("n"))
    rows = stored(rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("doc_id", "key").alias("at"), "n"), "members")
    stay = rows.groupBy("root").agg(F.min("at").alias("at"))
    own, gone_id, gone_key = fresh(df, "key"), fresh(df, "gone_id"), fresh(df, "gone_key")
    named = [F.col("at.doc_id").alias(gone_id), F.col("at.key").alias(gone_key)]
    gone = stored(rows.join(stay, ["root", "at"], "left_anti").select(*named), "near-copies")
    again = stored(rows.where("n > 1").join(stay, ["root", "at"], "left_semi").select(*named), "again")
    keyed = df.withColumn(own, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (F.col(own) == F.col(gone_key))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= KEYS_BROADCAST else gone, same, "left_anti")
    if not again.isEmpty():  # few: rows that were there twice
        twice = kept.join(again, same, "left_semi")
        kept = kept.join(again, same, "left_anti").unionByName(twice.dropDuplicates([id_col, own]))
    return kept.select(*df.columns)
