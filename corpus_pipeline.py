"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.  All stages but the last return the columns of documents.

No single SQL statement expresses the learned toxicity score, the templates or the encoding, so ORACLE_SQL is None;
tests/llm/test_pipeline.py checks run() against brute force.

Cases: documents without text, or with an empty one, and rows without a doc_id go through all stages and have no
tokens; texts of any length are read whole; rows that repeat a doc_id stay or go together in the near-duplicate stage
and are judged each on its own in the others; of equal documents the one with the smallest doc_id stays; further
columns, whatever their names, pass through all stages but the last, which returns its own; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, line_templates, minhash, toxicity
from tidemark.session import ensure_checkpoint_dir, fresh, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on these documents' labels, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "score", "predicted")
    return toxicity.score(docs, model, score=score, predicted=predicted).filter(F.col(predicted) == 0).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go."""
    return line_templates.drop_recurring_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    dropped = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with what they decode to as a digest."""
    encoded = bpe.encode_documents(docs, bpe.tokenizer_file(), decoded="decoded")
    n_tokens, ids_sha256, decoded_sha256 = bpe.digests(encoded)
    return encoded.select("doc_id", "lang", "source", "token_ids", n_tokens, ids_sha256, decoded_sha256)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
