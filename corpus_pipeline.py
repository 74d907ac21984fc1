"""A corpus made ready for training: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import table
from envspark.llm.exact_dedup import drop_exact
from envspark.llm.mixing import mix_rows
from envspark.llm.near_dup import drop_near
from envspark.llm.packing import pack_documents
from envspark.llm.toxicity import score_toxicity, train_toxicity
from envspark.session import remove_at_end, shared_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold; the model learns from those of them that are labelled."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter(~F.col("_toxic.flagged")).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of equal texts."""
    return drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts similar to 0.8 or more over five-word shingles."""
    return drop_near(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("source mix", mixed_sources),
    ("best-fit packing", packed),
]

#: Scores of a trained network and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    remove_at_end(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
