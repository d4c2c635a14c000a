import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracesift.llm import quality
from tracesift.llm.queries import op7_quality


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op7_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.95


def test_votes_against_plain_loop():
    rng = np.random.default_rng(1)
    model = quality.Voters(np.ones(quality.TRIGRAMS, np.float32), rng.standard_normal((quality.TERMS, 8)).astype(np.float32), np.zeros((0, 8), np.float32), (rng.random(40) < 0.5).astype(float))
    model.vectors = model.latent(rng.integers(0, 5, (40, quality.TERMS)).astype(np.float32))
    counts = rng.integers(0, 5, (300, quality.TERMS)).astype(np.float32)
    scores = model.scores(counts)
    for i in (0, 1, 255, 256, 299):
        cos = model.latent(counts[i : i + 1])[0] @ model.vectors.T
        near = sorted(range(40), key=lambda j: (-cos[j], j))[: quality.NEIGHBOURS]
        votes = [max(cos[j], 0) ** quality.SHARPNESS for j in near]
        want = sum(v * model.labels[j] for v, j in zip(votes, near, strict=True)) / sum(votes) if sum(votes) > 1e-12 else 0.5
        assert scores[i] == pytest.approx(want, rel=1e-3)


def test_counts_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["abcdef" * 50, None, "", "ab", "xyz", "é" * 30])
    whole = quality.term_counts(texts)
    monkeypatch.setattr(quality, "SLICE_BYTES", 16)
    assert (quality.term_counts(texts) == whole).all()
    assert whole[:, : quality.TRIGRAMS].sum(axis=1).tolist() == [298, 0, 0, 0, 1, 58]
    assert whole[:, quality.TRIGRAMS :].sum(axis=1).tolist() == [4, 0, 0, 4, 4, 4]


def test_very_long_text():
    """Longer than any slice, and read whole: its end counts as well."""
    text = "abc " * (3 * quality.SLICE_BYTES)
    counts = quality.term_counts(pa.array(["x", text + "%%%%", None]))
    assert counts[1, : quality.TRIGRAMS].sum() == len(text) + 2 and counts[1, quality.TRIGRAMS :].sum() == 4
    assert (counts[1] != quality.term_counts(pa.array([text]))[0]).any()


def test_defined_cases(spark):
    good, bad = "the cat sat on the mat and slept", "%%% $$$ ### *** &&& @@@"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)] + [(90, None), (91, ""), (None, good), (3, good)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    scored = quality.quality_scores(docs, quality.fit_voters(docs, labels)).collect()
    for r in scored:
        assert r.score == 0.5 if not r.text else (r.score > 0.5) == (r.text == good)
    none = quality.fit_voters(docs, labels.limit(0))
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_repeated_words():
    row = quality.term_counts(pa.array(["go go go go stop", "go stop go stop go"]))[:, quality.TRIGRAMS : quality.TRIGRAMS + len(quality.BINS) + 1]
    assert row.tolist() == [[0, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 0]]
