"""Benchmark decontamination: finds passages of benchmark items in documents, up to a share of edited words.

Texts are compared by their words, lower-cased and without punctuation. A CGK embedding walks through a window of words
with a pointer that, at every step, moves on or stays by a random bit of the word it stands on; two windows at a small edit
distance fall back into step after an edit, so their walks see the same words at most steps: edit distance becomes Hamming
distance. Bit-sampling LSH takes a few steps of the walk as a key; several samples of several walks bring the chance of a
common key near 1. Windows are as large as the items, in classes of sizes: an item's class is the largest whose windows fit
into it wherever it stands, and the item's windows at all offsets are in the index, so documents only need windows at
every STRIDE-th word. Candidates that hold enough of the item's words are verified by the exact edit distance of the item to the
best part of the document.

A benchmark of at most BLOCK_CHARS characters is broadcast as an index, and documents meet it in one pass without a shuffle. For a larger
one, items' keys are made in Spark and joined with those of documents' windows that a bit table of all items' keys lets through; then
each text with candidates meets the texts of its candidate items. Both ways find the same leaks.

Defined cases: null and empty texts leak nothing, items without words are found nowhere. Repeated items are each found;
repeated documents are judged alike. Items with a null id are found, with a null id. Of several places of one item, that
with the fewest edits, then the first, is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import SLICE_BYTES, mix, punctuation_bytes, text_buffers, word_hashes
from .common import add_columns, drop_stored, fresh, slices, stored, text_batches
from .sketches import key_filter, passes

#: Percent of an item's words that may be edited.
EDIT_PERCENT = 20
#: Window sizes of items. STRIDE is that of a document's windows, of which three lie wholly inside a passage, or else two,
#: or one; items too short for that have windows of their own size at every word.
SIZES, STRIDE = (8, 12, 16, 24), 8
WALKS = 6
#: More than the steps of any walk.
PAD = 64
#: Words of parts that are looked at together.
PART_WORDS = 2_000_000
#: Characters of a benchmark that is broadcast; its index has some 400 bytes a word.
BLOCK_CHARS = 1_000_000
LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("first_word", T.IntegerType())]))
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("first_word", pa.int32())]))
_PAST = np.uint64(0x5851F42D4C957F2D)


def sampled_steps(size: int, walk: int) -> list[list[int]]:
    """The steps of a walk that each of its keys takes, for windows of a size: one from each of as many stretches of the walk. Steps
    close together could all see the same word, and such a key would be that of many windows. Short windows have few steps that no
    edit moves, so their keys take fewer, and there are more keys."""
    rng = np.random.Generator(np.random.PCG64(1000 * size + walk))
    steps = min(max(1, size * 3 // 2), PAD - 1)
    taken, keys = (3, 4) if size < 12 else (4, 3) if size < 16 else (5, 3)
    ends = np.linspace(0, steps, min(steps, taken) + 1).astype(int)
    return [[int(rng.integers(a, b)) for a, b in zip(ends[:-1], ends[1:], strict=True)] for _ in range(keys)]


def padded(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with PAD words of no text after each text, so that walks end there; and each text's new first word."""
    moved = first + PAD * np.arange(len(first))
    out = np.full(len(words) + PAD * (len(first) - 1), _PAST)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(words)) + PAD * text] = words
    return out, moved


def walk_keys(words: np.ndarray, starts: np.ndarray, sizes: list[int], walk: int) -> dict[int, list[np.ndarray]]:
    """For each window size the keys of the windows that begin at starts, in one walk for all sizes. words: padded."""
    bits = mix(words ^ np.uint64(0x632BE59BD9B4E019 * (walk + 1) % 2**64))
    plans = {size: sampled_steps(size, walk) for size in sizes}
    keys = {size: [np.full(len(starts), np.uint64(size * 64 + walk * 8 + s)) for s in range(len(plan))] for size, plan in plans.items()}
    taken: dict[int, list[np.ndarray]] = {}
    for size, plan in plans.items():
        for s, steps in enumerate(plan):
            for step in steps:
                taken.setdefault(step, []).append(keys[size][s])
    at, move = starts.astype(np.int64), np.empty(len(starts), dtype=np.uint64)
    for step in range(max(taken) + 1):
        if step in taken:
            seen = words[at]
            for key in taken[step]:
                np.bitwise_xor(key, seen, out=key)
                np.multiply(key, np.uint64(0x9E3779B97F4A7C15), out=key)
        np.take(bits, at, out=move, mode="clip")
        np.right_shift(move, np.uint64(step), out=move)
        np.bitwise_and(move, np.uint64(1), out=move)
        np.add(at, move.view(np.int64), out=at)
    return {size: [mix(k) for k in made] for size, made in keys.items()}


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    return word_hashes(data, np.array([0, len(data)]), punctuation_bytes())[0]


def edits_within(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any run of words of the part, and the end of the first such run.
    Bit-parallel over the item's words."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for j, word in enumerate(part.tolist()):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Index:
    """A block of items and the keys of their windows, sorted."""

    ids: list[int | None]
    words: list[np.ndarray]
    keys: np.ndarray
    owners: np.ndarray  # item and offset of each key
    sizes: dict[int, list[int]]  # by stride
    table: np.ndarray  # which 20-bit beginnings of keys occur


def item_sizes(words: int) -> list[int]:
    """The window sizes for an item of so many words; the last is the best."""
    inside = lambda windows: [s for s in SIZES if s + windows * STRIDE - 1 <= words]
    return inside(3) or inside(2) or inside(1)[:1]


def item_keys(item: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of an item's words: the stride and size of its windows, and their keys and offsets."""
    fitting = item_sizes(len(item))
    size = fitting[-1] if fitting else len(item)
    offsets = np.arange(len(item) - size + 1)
    spaced = padded(item, np.array([0, len(item)]))[0]
    keys = [made for walk in range(WALKS) for made in walk_keys(spaced, offsets, [size], walk)[size]]
    return STRIDE if fitting else 1, size, np.concatenate(keys), np.tile(offsets, len(keys))


def build_index(items: list[tuple[int | None, str]]) -> Index:
    words = [words_of(text or "") for _, text in items]
    keys, owners, sizes = [], [], {STRIDE: set(), 1: set()}
    for number, item in enumerate(words):
        if not len(item):
            continue
        stride, size, made, offsets = item_keys(item)
        sizes[stride].add(size)
        keys.append(made)
        owners.append(np.stack((np.full(len(offsets), number), offsets), axis=1))
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    whose = np.concatenate(owners) if owners else np.zeros((0, 2), np.int64)
    order = np.argsort(every, kind="stable")
    table = np.zeros(1 << 20, dtype=bool)
    table[(every >> np.uint64(44)).astype(np.int64)] = True
    return Index([i for i, _ in items], words, every[order], whose[order].astype(np.int32), {k: sorted(v) for k, v in sizes.items()}, table)


def window_keys(words: np.ndarray, first: np.ndarray, sizes_by_stride: dict[int, list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of a slice of texts, key by key: each window's text, first word, and key."""
    count = np.diff(first)
    spaced, moved = padded(words, first)
    for stride, sizes in sizes_by_stride.items():
        if not sizes or not len(words):
            continue
        per = -(-count // stride)
        text = np.repeat(np.arange(len(count)), per)
        starts = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * stride
        for walk in range(WALKS):
            for made in walk_keys(spaced, starts + moved[:-1][text] - first[:-1][text], sizes, walk).values():
                for keys in made:
                    yield text, starts, keys


def candidates(index: Index, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of item, text and word that the item would begin at, counted in the slice, of windows that share a key; distinct and in order."""
    found = [np.zeros((0, 3), np.int64)]
    for text, starts, keys in window_keys(words, first, index.sizes):
        hit = np.flatnonzero(index.table[(keys >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(index.keys, keys[hit], "left"), np.searchsorted(index.keys, keys[hit], "right")
        count = high - low
        owner = index.owners[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        window = np.repeat(hit, count)
        found.append(np.stack((owner[:, 0], text[window], starts[window] - owner[:, 1]), axis=1))
    every = np.concatenate(found)
    every = every[np.lexsort(every.T[::-1])]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[1:] != every[:-1]).any(axis=1)
    return every[new]


def text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first and last row, the hashes of all words, each row's first word."""
    lowered = pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.large_string())
    data, offsets = text_buffers(lowered)
    for a, b in slices(np.maximum(np.diff(offsets), 1), SLICE_BYTES):
        words, _, _, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], punctuation_bytes())
        yield a, b, words, first


def edits_allowed(item: np.ndarray) -> int:
    return len(item) * EDIT_PERCENT // 100


def part_of(item: np.ndarray, start: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where an item may lie that would begin at start, in a text from first to end."""
    more = edits_allowed(item) + 1
    return np.maximum(start - more, first), np.minimum(start + len(item) + more, end)


def plausible(item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the parts low:high hold enough words of the item; where fewer do, too many are edited in any alignment."""
    out = np.zeros(len(low), dtype=bool)
    known, wide = np.unique(item), max(int((high - low).max(initial=0)), 1)
    each = max(PART_WORDS // wide, 1)
    for i in range(0, len(low), each):
        at = low[i : i + each, None] + np.arange(wide)
        seen = words[np.minimum(at, len(words) - 1)]
        same = known[np.minimum(np.searchsorted(known, seen), len(known) - 1)] == seen
        out[i : i + each] = (same & (at < high[i : i + each, None])).sum(axis=1) >= len(item) - edits_allowed(item)
    return out


def best_place(item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int] | None:
    """The least edits and the first word of an item in the parts low:high of a text, or None if all take too many edits."""
    best = None
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        edits, end = edits_within(item, words[a:b])
        place = (edits, max(a + end - len(item), 0))
        if edits <= edits_allowed(item) and (best is None or place < best):
            best = place
    return best


def leaks_in(index: Index, column: pa.Array) -> list[list[dict]]:
    """For each text of a column the items found in it."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for a, _, words, first in text_words(column):
        found = candidates(index, words, first)
        for of_item in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
            number = int(of_item[0, 0])
            item, text = index.words[number], of_item[:, 1]
            low, high = part_of(item, of_item[:, 2], first[text], first[text + 1])
            good = plausible(item, words, low, high)
            text, low, high = text[good], low[good], high[good]
            for of_text in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
                t = int(text[of_text[0]])
                place = best_place(item, words[first[t] : first[t + 1]], low[of_text] - first[t], high[of_text] - first[t])
                if place:
                    out[a + t].append({"item_id": index.ids[number], "edits": place[0], "first_word": place[1]})
    return out


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "leaks", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds out_col: the benchmark items found in the text, each with its edits and about where it begins."""
    spark = df.sparkSession
    text_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0)).alias("n")).first().n
    kept = [c for c in (df.columns if keep is None else keep) if c != out_col]
    if total > BLOCK_CHARS:
        return _joined_leaks(df, items, text_col, out_col, kept)
    rows = items.orderBy("id", "text").collect()  # BLOCK_CHARS at most
    shared = spark.sparkContext.broadcast(build_index([(r.id, r.text) for r in rows]))
    return add_columns(df, text_col, [(out_col, LEAK)], lambda texts: [pa.array(leaks_in(shared.value, texts), _LEAK)], kept)


def _joined_leaks(df: DataFrame, items: DataFrame, text_col: str, out_col: str, kept: list[str]) -> DataFrame:
    """find_leaks() by joins. Equal texts, of items or of documents, are handled once, under their checksum."""
    spark = df.sparkSession
    named = items.select("id", F.md5(F.col("text").cast("binary")).alias("item"), "text")
    apart = stored(named.groupBy("item").agg(F.first("text").alias("text")), "items")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(words := words_of(text)):
                    stride, size, keys, offsets = item_keys(words)
                    whole = lambda v, kind, n=len(keys): pa.array([v] * n, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), whole(item, pa.string()), pa.array(offsets.astype(np.int32)), whole(stride, pa.int32()), whole(size, pa.int32())], names=["window", "item", "offset", "stride", "size"])

    keys = stored(apart.mapInArrow(keys_of, "window long, item string, offset int, stride int, size int"), "item-keys")
    sizes: dict[int, list[int]] = {}
    for r in keys.select("stride", "size").distinct().orderBy("stride", "size").collect():  # some twenty at most
        sizes.setdefault(r.stride, []).append(r["size"])
    shared = spark.sparkContext.broadcast((sizes, key_filter(keys.select("window").distinct())))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_stride, table = shared.value
        for batch in batches:
            for a, _, words, first in text_words(batch.column(1)):
                for text, starts, made in window_keys(words, first, by_stride):
                    hit = np.flatnonzero(passes(table, made))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + text[hit])), pa.array(made[hit].view(np.int64)), pa.array((starts[hit] - first[text[hit]]).astype(np.int32))], names=["of", "window", "start"])

    texts = df.where(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col).cast("binary")).alias("of"), F.col(text_col).alias("text"))
    hits = texts.mapInArrow(windows, "of string, window long, start int")
    pairs = stored(hits.join(keys.select("window", "item", "offset"), "window").select("of", "item", (F.col("start") - F.col("offset")).alias("begin")).distinct(), "candidates")
    some = texts.join(pairs.select("of").distinct(), "of", "left_semi").groupBy("of").agg(F.first("text").alias("text"))

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        """The candidates of one text, and the text."""
        words = words_of(right.column("text")[0].as_py())
        begins: dict[str, list[int]] = {}
        texts: dict[str, str] = {}
        for item, text, begin in zip(*(left.column(c).to_pylist() for c in ("item", "item_text", "begin")), strict=True):
            texts[item] = text
            begins.setdefault(item, []).append(begin)
        best: dict[str, tuple[int, int]] = {}
        for name, starts in begins.items():
            item = words_of(texts[name])
            low, high = part_of(item, np.array(starts, dtype=np.int64), np.int64(0), np.int64(len(words)))
            good = plausible(item, words, low, high)
            if place := best_place(item, words, low[good], high[good]):
                best[name] = place
        of = right.column("of")[0].as_py()
        return pa.table({"of": pa.array([of] * len(best), pa.string()), "item": pa.array(list(best), pa.string()), "edits": pa.array([e for e, _ in best.values()], pa.int32()), "first_word": pa.array([w for _, w in best.values()], pa.int32())})

    full = pairs.join(apart.select("item", F.col("text").alias("item_text")), "item")
    found = full.groupBy("of").cogroup(some.groupBy("of")).applyInArrow(verify, "of string, item string, edits int, first_word int")
    each = found.join(named.select("id", "item"), "item").select("of", F.struct(F.col("id").alias("item_id"), "edits", "first_word").alias("leak"))
    per = stored(each.groupBy("of").agg(F.array_sort(F.collect_list("leak")).alias("found")), "leaks")
    drop_stored(keys, pairs, apart)
    own, made = fresh(df, "of"), fresh(df, "found")
    joined = df.join(per.select(F.col("of").alias(own), F.col("found").alias(made)), F.md5(F.col(text_col).cast("binary")) == F.col(own), "left")
    return joined.select(*kept, F.coalesce(F.col(made), F.array().cast(LEAK)).alias(out_col))
