"""The corpus pipeline: documents -> quality classifier -> exact dedup -> SimHash near-dedup ->
mixing -> BPE ids. Each stage works on all that the stage before it kept; every stage's rows are written
as Parquet under the cluster's shared checkpoint folder and read again.

Every stage handles nulls, empty texts, repeated rows, empty tables and extra columns as its operator
defines (see the operators' docstrings). Mixing uses every document at least once and repeats documents of
small sources, as rows of their own, up to its repetition limit.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, common, exact_dedup, mixing, quality_classifier, simhash
from framelake.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts."""
    return quality_classifier.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each class of linked fingerprints."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, in blocks of the training order."""
    out = mixing.mix(docs, names=("__copy", "__position", "__block"))
    out = out.repartition("__block").sortWithinPartitions("__block", "__position", "doc_id")
    return out.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row."""
    return bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY), ("doc_id", "source"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("mixing", mixed), ("bpe", encoded)]

# The classifier's weights are fitted numbers and the merges are rules of a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    where = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with common.staging(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{where}/{k}-{name}")
        if k:
            common.delete(spark, f"{where}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
