"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes two blocks of terms of equal weight. One holds counts of its hashed byte trigrams (digits taken
as one), dampened by log1p and weighted by inverse document frequency in the labelled sample; the other
says into which of a few bins each of its shares falls: words that repeat the one before, punctuation, digits and
capitals. Both are projected to a few latent dimensions by a truncated SVD of the sample. The labelled vectors are broadcast; for every document the cosines with
all of them come from one exact product per block of documents, and the NEIGHBOURS most similar vote
for their labels with their similarity.

The shares are plain statistics beside the latent-semantic vector, and decide much: README has the accuracy with and without them.

Only the fit is bounded: PER_CLASS labelled rows of each label, those of least hash of their id, so the
sample is the same for every partitioning. Every document is scored, and read whole.

Defined cases: a null text is an empty one; an empty text, and any text if nothing is labelled, gets
the score 0.5. Rows with a null id or label don't train. Repeated label rows train once for each pair of
id and label; repeated documents are scored alike. Ties among neighbours go to the earlier sample row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import punctuation_bytes, space_bytes, text_buffers, word_hashes
from .common import add_columns, slices, text_batches

TRIGRAMS = 2048
#: Upper ends of the bins of a share, but the last.
BINS = (0.0, 0.01, 0.03, 0.1, 0.3)
SHARES = 4
TERMS = TRIGRAMS + SHARES * (len(BINS) + 1)
LATENT = 48
PER_CLASS = 1024
NEIGHBOURS = 15
#: Similarity's exponent as a vote.
SHARPNESS = 4.0
SLICE_BYTES = 1 << 20
BLOCK = 256


def held_out(doc_id: Column) -> Column:
    """Whether the row's label must not be learnt: the id's checksum leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def term_counts(column: pa.Array) -> np.ndarray:
    """A row for each text: counts of hashed byte trigrams, then a 1 in one bin of each share; zeros if the text has no word."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, TERMS), dtype=np.float32)
    table = np.arange(256, dtype=np.uint32)
    table[48:58] = 48
    marks, space = punctuation_bytes() & ~space_bytes(), space_bytes()
    kinds = (marks, _byte_range(48, 57), _byte_range(65, 90))
    for a, b in slices(np.diff(offsets), SLICE_BYTES):
        part, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, _, _, first = word_hashes(part, places, space)
        same = np.zeros(len(words) + 1, dtype=np.int64)
        if len(words):
            again = np.append(False, words[1:] == words[:-1])
            again[first[:-1][first[:-1] < len(words)]] = False
            np.cumsum(again, out=same[1:])
        count = np.diff(first)
        shares = [(same[first[1:]] - same[first[:-1]]) / np.maximum(count, 1)]
        for kind in kinds:
            so_far = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum(kind[part], out=so_far[1:])
            shares.append((so_far[places[1:]] - so_far[places[:-1]]) / np.maximum(np.diff(places), 1))
        rows = np.flatnonzero(count > 0)
        for n, share in enumerate(shares):
            out[a + rows, TRIGRAMS + n * (len(BINS) + 1) + np.searchsorted(BINS, share[rows], "left")] = 1
        for start in range(offsets[a], offsets[b], 8 * SLICE_BYTES):  # a very long text in parts that overlap by two bytes
            coded = table[data[start : min(start + 8 * SLICE_BYTES + 2, offsets[b])]]
            if len(coded) < 3:
                continue
            hashed = (coded[:-2] * np.uint32(2654435761) ^ coded[1:-1] * np.uint32(2246822519) ^ coded[2:] * np.uint32(3266489917)) >> np.uint32(21)
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))[start - offsets[a] :][: len(coded)]
            whole = row[:-2] == row[2:]
            key = row[:-2][whole] * TRIGRAMS + hashed[whole]
            out[a:b, :TRIGRAMS] += np.bincount(key, minlength=(b - a) * TRIGRAMS).reshape(b - a, TRIGRAMS)
    return out


def _byte_range(first: int, last: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[first : last + 1] = True
    return table


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-12)


@dataclass
class Voters:
    """A fitted model; of fixed size whatever the corpus."""

    weights: np.ndarray  # by trigram
    projection: np.ndarray  # terms x latent
    vectors: np.ndarray  # sample rows x latent, of length 1
    labels: np.ndarray

    def terms(self, counts: np.ndarray) -> np.ndarray:
        return np.concatenate((_unit(np.log1p(counts[:, :TRIGRAMS]) * self.weights), _unit(counts[:, TRIGRAMS:])), axis=1)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.terms(counts) @ self.projection)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of the vote for label 1."""
        out = np.full(len(counts), 0.5)
        if not len(self.labels):
            return out
        near = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), BLOCK):
            cosines = self.latent(counts[a : a + BLOCK]) @ self.vectors.T
            best = np.argsort(-cosines, axis=1, kind="stable")[:, :near] if len(self.labels) <= near else _first(cosines, near)
            votes = np.maximum(np.take_along_axis(cosines, best, axis=1), 0.0).astype(np.float64) ** SHARPNESS
            total = votes.sum(axis=1)
            won = (votes * self.labels[best]).sum(axis=1)
            out[a : a + BLOCK] = np.divide(won, total, out=out[a : a + BLOCK].copy(), where=total > 1e-12)
        return np.clip(out, 0.0, 1.0)


def _first(cosines: np.ndarray, near: int) -> np.ndarray:
    """The columns of the largest values of each row."""
    part = np.sort(np.argpartition(-cosines, near - 1, axis=1)[:, :near], axis=1)
    order = np.argsort(-np.take_along_axis(cosines, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def fit_voters(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_class: int = PER_CLASS) -> Voters:
    """Fits on at most per_class rows of each label that aren't held out."""
    text_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = part if sample is None else sample.unionAll(part)
    # At most 2 * per_class rows of two numbers.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = term_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([row.tobytes() for row in counts], pa.binary())], names=["id", "label", "counts"])

    rows = texts.mapInArrow(count, T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("counts", T.BinaryType())]))
    found = {}
    for row in rows.groupBy("id", "label").agg(F.min("counts").alias("counts")).collect():
        found[row.id, row.label] = np.frombuffer(row.counts, dtype=np.float32)
    order = sorted(found)
    if not order:
        return Voters(np.zeros(TRIGRAMS, np.float32), np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0))
    counts = np.stack([found[k] for k in order])
    weights = np.log((1 + len(counts)) / (1 + (counts[:, :TRIGRAMS] > 0).sum(axis=0))).astype(np.float32) + 1
    model = Voters(weights, np.zeros((TERMS, 0), np.float32), np.zeros((0, LATENT), np.float32), np.array([label for _, label in order], dtype=np.float64))
    model.projection = _axes(model.terms(counts))
    model.vectors = model.latent(counts)
    return model


def _axes(made: np.ndarray) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rng = np.random.Generator(np.random.PCG64(7))
    size = min(LATENT, *made.shape)
    axes = rng.standard_normal((made.shape[1], size + 8)).astype(np.float32)
    for _ in range(8):
        axes, _ = np.linalg.qr(made.T @ (made @ axes))
    small = made @ axes
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    return (axes @ turn.T[:, :size]).astype(np.float32)


def quality_scores(df: DataFrame, model: Voters, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds score_col, from 0 to 1: higher, the likelier label 1. keep: the columns that stay, all unless given."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([shared.value.scores(term_counts(texts.slice(a, BLOCK))) for a in range(0, len(texts), BLOCK)]), pa.float64())]

    return add_columns(df, text_col, [(score_col, T.DoubleType())], make, keep)
