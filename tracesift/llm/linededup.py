"""Line dedup by a deletion-neighbourhood join: lines equal to an earlier line, or one edit away from one, go.

Lines are what line feeds part; blank ones always stay. Lines are ordered by document id, then by place. A line
goes if an earlier line has the same characters, or if both have more than max_edits characters (else an edit could be the
whole line) and their edit distance (code points inserted, deleted or replaced) is at most max_edits, 0 or 1. The
earliest stays. Whether the earlier line itself stays doesn't matter, so the result doesn't depend on the order of work.

Two lines are within one edit if deleting one character from one gives the other, or deleting one from each at the same
place gives the same variant. Emitting a key for every variant of every line would be as many keys as characters, so it
is done in two steps with the same result:

1. Blocks. A line is cut into 4 to 8 blocks (or single characters, if short); for each, the line without it is a key (a hash of
   what precedes and what follows; the width depends on the length, lines next to a change of widths emit keys for both). All
   variants of a block share its key. Keys that different lines have leave the lines that could have a partner.
2. Variants. Those lines emit the variants of such blocks, hashed, with the place of the deletion. Rows of equal variants are ordered
   by their lines: the first is the earliest partner of all others. No pairs within a group are made.

The pairs found, one per line at most, are verified by their edit distance. Equal lines are told by 128-bit digests.

Defined cases: a null text has no lines; an empty text has one blank line. Rows that repeat both document id and text share their
lines' places: equal lines at equal places all stay. Rows that share an id only are apart: equal lines at equal places are
ordered by a hash of id and text. Rows with a null id come last. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import by_place, digest, mix, running
from .common import broadcast_small, drop_stored, fresh, list_array, slices, stored, text_batches

SLICE_CHARS = 1 << 17
_LAST = 2**63 - 1


@dataclass
class Lines:
    """The lines of a slice of texts."""

    text: str  # all texts of the slice, with line feeds between
    points: np.ndarray  # its code points
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of each line
    blank: np.ndarray
    before: np.ndarray  # running sums of the code points by their place from the line's start

    def digests(self, which: np.ndarray) -> list[bytes]:
        data = memoryview(self.points).cast("B")
        return [digest(data[4 * a : 4 * b]) for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def places(self, ends: bool) -> np.ndarray:
        """Of each code point (line feeds too) the place from its line's start, or to its end."""
        size = self.ends - self.starts + 1
        of = np.repeat((self.ends if ends else self.starts).astype(np.int32), size)[: len(self.points)]
        at = np.arange(len(of), dtype=np.int32)
        return of - at if ends else at - of


def lines_in(texts: list[str]) -> Iterator[Lines]:
    for a, b in slices(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), SLICE_CHARS):
        joined = "\n".join(texts[a:b])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        feeds = np.flatnonzero(points == 10)
        starts, ends = np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(points)]))
        per_text = np.fromiter((t.count("\n") + 1 for t in texts[a:b]), np.int64, b - a)
        solid = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(~((points == 32) | ((points >= 9) & (points <= 13))), out=solid[1:])
        found = Lines(joined, points, starts, ends, np.repeat(np.arange(a, b), per_text), solid[ends] == solid[starts], np.zeros(0))
        found.before = running(by_place(points, found.places(False)))
        yield found


def block_shapes(length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Width and number of the blocks of lines so long; first their own, then those of lines one character longer."""
    out = []
    for size in (length, length + 1):
        width = np.maximum((1 << np.log2(np.maximum(size, 1)).astype(np.int64)) // 4, 1)
        out.append((width, size // width))
    return out


def block_keys(lines: Lines, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key of the lines numbered by use: the line's place in use, the key, and start and end of the block left out."""
    found = []
    starts, ends = lines.starts[use], lines.ends[use]
    after = running(by_place(lines.points, lines.places(True), seed=1))
    (width, number), (width2, number2) = block_shapes(ends - starts)
    other = (width2 != width) | (number2 != number)
    for which, w, n in ((np.arange(len(starts)), width, number), (np.flatnonzero(other), width2[other], number2[other])):
        line = np.repeat(which, n)
        w, n, j = np.repeat(w, n), np.repeat(n, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        left, right = starts[line] + j * w, ends[line] - (n - 1 - j) * w
        shape = (w * 64 + j * 8 + n).astype(np.uint64)
        key = mix((lines.before[left] - lines.before[starts[line]]) * np.uint64(3) + mix(after[ends[line]] - after[right] + shape))
        found.append((line, key, left, right))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def variants_of(lines: Lines, use: np.ndarray, line: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the blocks of lines: the line (its place in use), the code point left out, and a hash of what remains; once a code point."""
    size = right - left
    of, at = np.repeat(line, size), np.repeat(left - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    at, keep = np.unique(at, return_index=True)
    of = of[keep]
    s, e = lines.starts[use][of], lines.ends[use][of]
    moved = running(by_place(lines.points, np.maximum(lines.places(False) - 1, 0)))  # a code point after the gap moves up
    return of, at, mix(lines.before[at] - lines.before[s] + moved[e] - moved[at + 1] + (e - s - 1).astype(np.uint64))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _key(doc_id, text):
    """Tells rows apart; only rows that repeat id and text share it."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), text)


def duplicate_lines(df: DataFrame, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, line (from 0), kept_doc_id, kept_line, edits: a row for each line that goes, with the earliest line that it
    repeats. The key is a hash of document id and text; rows that repeat both have one row for a line."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    spark = df.sparkSession
    text_batches(spark)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), _key(id_col, F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # lines of this task that have emitted their blocks
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lines in lines_in(_texts(batch.column(2))):
                number = np.arange(len(lines.starts)) - np.searchsorted(lines.row, lines.row)
                some = np.flatnonzero(~lines.blank)
                names = lines.digests(some)
                new = (lines.ends - lines.starts)[some] > max_edits
                for i, name in enumerate(names):
                    if name in seen:
                        new[i] = False
                    else:
                        seen.add(name)
                if len(seen) > 500_000:
                    seen.clear()
                use = np.flatnonzero(new)
                line, key, _, _ = block_keys(lines, some[use]) if max_edits else (np.zeros(0, np.int64), np.zeros(0, np.uint64), None, None)
                per = np.zeros(len(some), dtype=np.int64)
                per[use] = np.bincount(line, minlength=len(use))
                order = np.argsort(line, kind="stable")
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.binary()), pa.array(ids[lines.row[some]]), pa.array(number[some]), pa.array(keys[lines.row[some]]),
                    list_array(key[order].view(np.int64), per, pa.int64()),
                ], names=["digest", "doc_id", "line", "key", "blocks"])

    lines = stored(docs.mapInArrow(scan, "digest binary, doc_id long, line long, key long, blocks array<long>"), "lines")
    first = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line", "key")).alias("first"), F.count("*").alias("n"))
    if max_edits:
        near, made = _near_lines(docs, lines, max_edits)
        first = first.join(near, "digest", "left")
    else:
        first, made = first.withColumn("kept", F.lit(None).cast("struct<doc_id:bigint,line:bigint,key:bigint>")), []
    # Only lines that go somewhere are joined; a line of very many occurrences may be split by adaptive execution.
    first = stored(first.where("n > 1 or kept is not null").drop("n"), "gone-lines")
    drop_stored(*made)
    gone = lines.select("digest", F.struct("doc_id", "line", "key").alias("at")).join(first, "digest").where((F.col("at") != F.col("first")) | F.col("kept").isNotNull())
    # Of an equal line and a near one, the earlier is named.
    best = F.coalesce("kept", "first")
    null_last = lambda c: F.when(c != _LAST, c)
    out = gone.select(null_last(F.col("at.doc_id")).alias("doc_id"), F.col("at.key").alias("key"), F.col("at.line").alias("line"), null_last(best["doc_id"]).alias("kept_doc_id"), best["line"].alias("kept_line"), F.when(F.col("kept").isNotNull(), 1).otherwise(0).alias("edits"))
    return out.distinct()


def _near_lines(docs: DataFrame, lines: DataFrame, max_edits: int) -> tuple[DataFrame, list[DataFrame]]:
    """digest, kept: for every line text with an earlier one at an edit distance of 1, the earliest of these. And the tables that it reads."""
    # Step 1. Block keys that lines of different texts have; 64 bits of the digests tell them apart here. A running window streams, however large the group.
    rows = lines.select(F.xxhash64("digest").alias("short"), F.explode("blocks").alias("block")).repartition("block")
    order = Window.partitionBy("block").orderBy("short")
    rows = rows.withColumns({"before": F.lag("short").over(order), "after": F.lead("short").over(order)})
    shared = rows.where("before != short or after != short").groupBy("short").agg(F.collect_set("block").alias("shared"))  # some of a line's own blocks
    shared = stored(shared, "shared-blocks")
    # The lines that have them by the place where they first occur, numbered in that order: ranges of places go to tasks in order, and
    # numbers grow within and across tasks.
    first = lines.select("digest", "doc_id", "line", "key").join(broadcast_small(shared), F.xxhash64("digest") == F.col("short"))
    first = first.groupBy("digest").agg(F.min(F.struct("doc_id", "line", "key")).alias("at"), F.first("shared").alias("shared"))
    ranked = stored(first.repartitionByRange("at", "digest").sortWithinPartitions("at", "digest").select("digest", "at", "shared", F.monotonically_increasing_id().alias("rank")), "ranks")
    # Their texts, from the documents that hold them first.
    wanted = ranked.select(F.col("at.key").alias("key"), F.col("at.line").alias("line"), "rank", "digest", "at", "shared")
    some = stored(wanted.select("key").distinct(), "wanted")
    held = docs.join(broadcast_small(some), "key", "left_semi").select("key", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    texts = stored(held.join(broadcast_small(wanted), ["key", "line"]).dropDuplicates(["rank"]).select("rank", "digest", "at", "shared", "text"), "line-texts")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column(0).to_numpy()
            blocks = batch.column(2).flatten().to_numpy().view(np.uint64)
            for lines in lines_in(_texts(batch.column(1))):
                every = np.arange(len(lines.starts))
                line, key, left, right = block_keys(lines, every)
                hit = np.flatnonzero(np.isin(key, blocks))
                of, at, made = variants_of(lines, every, line[hit], left[hit], right[hit])
                whole = mix(lines.before[lines.ends] - lines.before[lines.starts] + (lines.ends - lines.starts).astype(np.uint64))
                count = np.bincount(of, minlength=len(every))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ranks[lines.row]), pa.array(whole.view(np.int64)), list_array(made.view(np.int64), count, pa.int64()), list_array((at - lines.starts[of]).astype(np.int32), count, pa.int32()),
                ], names=["rank", "whole", "variants", "places"])

    single = texts.select("rank", "text", "shared").mapInArrow(variants, "rank long, whole long, variants array<long>, places array<int>")
    # Step 2. Rows by variant: a line without one character, or (place -1) as it is.
    rows = single.select("rank", F.explode(F.concat(F.arrays_zip("variants", "places"), F.array(F.struct(F.col("whole").alias("variants"), F.lit(-1).alias("places"))))).alias("v"))
    rows = rows.select(F.col("v.variants").alias("variant"), F.col("v.places").alias("place"), "rank").repartition("variant")
    by_place = Window.partitionBy("variant", "place").orderBy("rank")
    by_variant = Window.partitionBy("variant").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("place") == -1
    rows = rows.withColumn("replaced", F.first("rank").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("longer", F.min(F.when(~whole, F.col("rank"))).over(by_variant)).withColumn("shorter", F.min(F.when(whole, F.col("rank"))).over(by_variant))
    earliest = F.when(whole, F.col("longer")).otherwise(F.least("replaced", "shorter"))
    found = rows.select("rank", earliest.alias("kept")).where("kept is not null and kept < rank").groupBy("rank").agg(F.min("kept").alias("kept"))
    # Verified once per line.
    both = found.join(texts.select("rank", "digest", "text"), "rank").join(texts.select(F.col("rank").alias("kept"), F.col("at").alias("kept_at"), F.col("text").alias("kept_text")), "kept")
    near = both.where(F.levenshtein("text", "kept_text", 1) == 1).select("digest", F.col("kept_at").alias("kept"))
    return near, [shared, ranked, some, texts]


def dedup_lines(df: DataFrame, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the lines that go. Documents all of whose lines go are left out; others stay, with what is left of
    their text. Rows with a null id stay as they are."""
    own, places, ids = fresh(df, "key"), fresh(df, "places"), fresh(df, "of")
    gone = duplicate_lines(df.where(F.col(id_col).isNotNull()), max_edits, id_col, text_col)
    gone = stored(gone.groupBy(F.col("doc_id").alias(ids), F.col("key").alias(own)).agg(F.collect_set(F.col("line").cast("int")).alias(places)), "gone")
    joined = df.join(broadcast_small(gone), (F.col(id_col).cast("long") == F.col(ids)) & (_key(id_col, F.col(text_col)) == F.col(own)), "left")
    # Bound to lambdas, so that a text is split once, however many of its lines stay.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    left = bound(F.split(F.col(text_col), "\n", -1), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places)), lambda i: F.get(lines, i)))
    blank = lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) == 0
    made = bound(left, lambda some: F.struct(F.array_join(some, "\n").alias("text"), (~F.forall(some, blank)).alias("solid")))
    changed = F.col(places).isNotNull()
    text = F.when(changed, made["text"]).otherwise(F.col(text_col))
    return joined.where(~changed | made["solid"]).withColumn(text_col, text).select(*df.columns)


def line_report(df: DataFrame, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places of the lines that go, in order) for every row of df."""
    gone = duplicate_lines(df, max_edits, id_col, text_col).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("own")).agg(F.array_sort(F.collect_set("line")).alias("removed"))
    lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    counted = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", _key("doc_id", F.col("text")).alias("key"), lines.alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return counted.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("own")), "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
