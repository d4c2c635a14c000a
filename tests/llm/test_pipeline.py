import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tokenizers import Tokenizer
from tracesift.llm import decontaminate, quality
from tracesift.llm.jaccard import jaccard_join
from tracesift.llm.linededup import duplicate_lines
from tracesift.llm.queries import vocabulary

from test_jaccard import brute as brute_components
from test_linededup import BLANK
from test_linededup import brute as brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ends = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        after = {r.doc_id: r for r in docs.collect()}
        ends.append(set(after))
        assert set(after) <= set(before)
        if name != "tokens":
            assert docs.columns == COLUMNS
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert np.mean([(d in after) == bool(labels[d]) for d in before if d in labels]) > 0.95
        if name == "lines":  # what the stage keeps has no line left that goes
            assert duplicate_lines(docs).where("edits = 0").count() == 0
        if name == "near copies":
            assert jaccard_join(docs).where("component_id != doc_id").count() == 0
        if name == "benchmark":
            assert decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(leaks) > 0").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ends[-1]


def test_against_brute_force(spark):
    """The whole pipeline against each stage done plainly, one document after another."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_voters(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r, score in zip(rows, model.scores(quality.term_counts(pa.array([t for _, t in rows]))), strict=True) if score >= 0.5]
    gone = brute_lines(rows, 1)
    left = []
    for i, text in rows:
        lines = text.split("\n")
        stay = [line for n, line in enumerate(lines) if (i, n) not in gone]
        if len(stay) == len(lines) or any(line.strip(BLANK) for line in stay):
            left.append((i, "\n".join(stay)))
    keep = {c for _, n, c in brute_components(left, 5, 80) if n}
    left = [(i, t) for i, t in left if i in keep or not t.split()]
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = {i: decontaminate.words_of(t) for i, t in left}
    left = [(i, t) for i, t in left if not any(decontaminate.edits_within(item, words[i])[0] <= len(item) * decontaminate.EDIT_PERCENT // 100 for item in items if len(item))]
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(got) < len(rows)


def test_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two three four five six", "en", "s", 1), (3, "one two three four five six", "en", "s", 1), (3, "one two three four five six", "en", "s", 1), (4, "w " * 30_000, "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("__score", "score", "leaks", "key", "of", "Places", "gone_id", "gone_key", "source_", "line", "digest", "node", "found")})
    for table in (df, df.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        got = sorted(((r.doc_id, r.n_tokens) for r in docs.collect()), key=str)
        assert got == ([] if table is not df else sorted([(1, 0), (2, 0), (None, 6), (3, 6), (4, 30_000)], key=str))
