"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

1. quality: documents that the classifier scores below 0.5 go.
2. lines: lines that repeat an earlier line, up to one edit, go; so do documents that had nothing else.
3. near copies: of each group of documents linked by their word shingles one stays, that with the smallest id. Rows that share
   an id but no such link all stay.
4. benchmark: documents that hold a passage of a benchmark item go.
5. tokens: every text is encoded.

Rows with a null id take part in stages 1, 4 and 5; stages 2 and 3 keep them as they are. Further columns pass through all stages
but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import bpe, decontaminate, jaccard, linededup, quality
from tracesift.llm.common import fresh, shared_dir
from tracesift.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_voters(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.quality_scores(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs, max_edits=1)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = fresh(docs, "leaks")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), out_col=leaks).where(F.size(leaks) == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs, vocabulary(), keep=["doc_id"]).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near copies", near_copy_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: Nearest neighbours in a latent space, and encoding, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the stages' tables are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
