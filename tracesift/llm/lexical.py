"""Ranked lexical search: the best documents for each item by weighted terms, documents of one bag scored once.

A document is cut to the items' vocabulary: the terms it shares with any item, how often each occurs, and m, a measure of the whole
document's length. Documents with the same terms, frequencies and m have the same score for every item; they form a class, found by a
hash and told apart by the bags themselves. A class keeps its k members of smallest doc_id, is scored once for all items, and is expanded
only in the k best of an item, where members of all classes of one score stand in order of doc_id.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. A term's weight w is
floor(1000 ln((2N + 2) / (2 df + 1))), m is 10 + 90 n N div L, and a term adds w ((10^9 tf) div (1000 tf + 8 m)).

Items come in blocks of BLOCK_CHARS characters; each block is one pass over the documents, and what is broadcast is one block's
vocabulary. Each task keeps the k best of each item; those of all tasks are ranked by a window over the item.

Defined cases: null texts have no terms; documents without terms count neither in N nor in L and are never found; items without terms
find nothing; scores of 0 are left out; null doc_ids come last among equal scores; repeated documents are found each; an item repeated
with its text counts once, items of one id with different texts are ranked apart; empty tables give no rows; other columns are ignored.
Texts of any length are read whole, some megabytes at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, drop_stored, list_array, stored, text_batches

#: Characters of a block of items, bytes of a text that are cut into words at once, and numbers that scoring holds at once.
BLOCK_CHARS, PIECE, CELLS = 1_000_000, 4 << 20, 1 << 22
#: The largest sum that doubles hold exactly.
_EXACT = 2**53

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text in UTF-8."""
    found: Counter = Counter()
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(_TABLE)
        cut = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        found.update(piece[:cut].split())
        rest = piece[cut:]
    return found


class Block:
    """The items of one block: their vocabulary, and for every term the items that hold it."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        terms = [sorted(term_counts((text or "").encode())) for _, text in items]
        self.vocabulary = {t: n for n, t in enumerate(sorted({t for own in terms for t in own}))}
        term = np.array([self.vocabulary[t] for own in terms for t in own], dtype=np.int64)
        item = np.repeat(np.arange(len(items)), [len(own) for own in terms])
        order = np.argsort(term, kind="stable")
        self.holders = item[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.most_terms = max(map(len, terms), default=0)


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """Items dealt to blocks by a hash; the driver holds one block at a time."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    if n > 1:
        rows = stored(rows, "items")
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if found:
            yield Block(found)


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and of the vocabulary's terms those that occur, in order, and how often: terms, tfs."""

    def make(texts: pa.Array) -> list[pa.Array]:
        n, lengths, terms, tfs = [], [], [], []
        for text in texts:
            counts = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else {}
            known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
            n.append(sum(counts.values()))
            lengths.append(len(known))
            terms += [t for t, _ in known]
            tfs += [c for _, c in known]
        lengths = np.array(lengths, dtype=np.int64)
        return [pa.array(n, pa.int64()), list_array(np.array(terms, np.int32), lengths, pa.int32()), list_array(np.array(tfs, np.int64), lengths, pa.int64())]

    fields = [("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.LongType()))]
    return add_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", fields, make, keep=["doc_id"])


def classes(found: DataFrame, k: int) -> DataFrame:
    """Documents of one bag and m: m, terms, tfs, members (k at most, by doc_id). What exceeds k is dropped before the shuffle, too."""
    bag = ["hash", "m", "terms", "tfs"]
    rows = found.withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    nth = F.row_number().over(Window.partitionBy(*bag).orderBy(F.col("doc_id").asc_nulls_last()))
    first = rows.select(*bag, "doc_id", nth.alias("nth")).where(F.col("nth") <= k)
    return first.groupBy(*bag).agg(F.sort_array(F.collect_list(F.struct("nth", "doc_id"))).alias("members")).select("m", "terms", "tfs", F.col("members.doc_id").alias("members"))


class Best:
    """The k best (item, score, doc_id) of each item so far, as arrays. Null ids are the largest."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, dtype=np.int64)
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(p) for p in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        full = rank == self.k - 1
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[order], doc[order], null[order]
        self.least[item[full]] = self.score[np.flatnonzero(full[rank < self.k])]


def scores(block: Block, weights: np.ndarray, m: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The first class and the scores (classes x items) of some classes at a time."""
    items = len(block.ids)
    held = block.first[terms + 1] - block.first[terms]
    ends = np.cumsum(lengths)
    work = np.concatenate([[0], np.cumsum(held)])[ends] if len(ends) else ends
    exact = float(block.most_terms) * float(weights.max(initial=0)) * 1e6 < _EXACT
    start = 0
    while start < len(lengths):
        done = work[start - 1] if start else 0
        stop = max(start + 1, min(start + max(1, CELLS // items), int(np.searchsorted(work, done + CELLS, side="right"))))
        a, b = (ends[start - 1] if start else 0), ends[stop - 1]
        t, f, n = terms[a:b], tfs[a:b], held[a:b]
        row = np.repeat(np.arange(stop - start), lengths[start:stop])
        value = weights[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[start:stop][row]))
        entry = np.repeat(np.arange(b - a), n)
        holder = block.holders[block.first[t][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]
        cell = row[entry] * items + holder
        if exact:
            total = np.bincount(cell, weights=value[entry], minlength=(stop - start) * items).astype(np.int64)
        else:
            total = np.zeros((stop - start) * items, dtype=np.int64)
            np.add.at(total, cell, value[entry])
        yield start, total.reshape(stop - start, items)
        start = stop


def best_of(found: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        for batch in batches:
            m, terms, tfs, members = batch.columns
            flat = members.flatten()
            sizes = np.diff(members.offsets.to_numpy())
            at = np.cumsum(sizes) - sizes
            docs, null = flat.fill_null(0).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)
            for start, total in scores(block, weights, m.to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64), terms.flatten().to_numpy(), tfs.flatten().to_numpy()):
                least = best.least
                if len(total) > k:
                    least = np.maximum(least, np.partition(total, len(total) - k, axis=0)[len(total) - k])
                row, item = np.nonzero(total >= least)
                score, row = total[row, item], row + start
                n = sizes[row]
                place = np.repeat(at[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                best.add(np.repeat(item, n), np.repeat(score, n), docs[place], null[place])
        for a in range(0, len(best.item), 10_000):
            part = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(best.item[part].astype(np.int32)), pa.array(best.doc[part], mask=best.null[part]), pa.array(best.score[part])], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    out = None
    for block in blocks_of(items):
        if not block.vocabulary:
            continue
        held = stored(bags(docs, block.vocabulary).where("n > 0"), "bags")
        count, length = held.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
            df[r.term] = r["count"]
        weights = np.array([floor(1000 * log((2 * count + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        m = F.expr(f"10 + (cast(90 * n as decimal(20, 0)) * cast({count} as decimal(18, 0))) div {length or 1}")
        found = classes(held.where(F.size("terms") > 0).withColumn("m", m.cast("long")), k)
        best = best_of(found, block, weights, k)
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
        rows = best.withColumn("rank", nth).where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        rows = stored(rows, "found")
        drop_stored(held)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], T.StructType([items.schema["item_id"], *T.StructType.fromDDL("rank int, doc_id long, score long").fields]))
