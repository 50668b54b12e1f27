"""The corpus pipeline: documents through five operators, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenshelf.functions.storage import removed, shared_folder
from lumenshelf.llm import bpe, curriculum, exact_dedup, language_id, simhash
from lumenshelf.llm.common import table
from lumenshelf.llm.queries import vocabulary_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not known."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target, in training order; a document taken twice has two rows."""
    return curriculum.training_sequence(docs, position_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode each text: digests of ids and of the decoded text."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("language ID", identify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mix sources", mix),
    ("BPE", tokenize),
]

#: Language models and byte-pair merges are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are written to the shared checkpoint folder; once
    a stage is written whole, what it read goes."""
    folder, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            removed(spark, before)
        before = out
    return docs
