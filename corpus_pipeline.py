"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; each works on every row its predecessor kept.  What a
stage wrote on its way is deleted once its result is written.

Defined results, for every stage: null text is an empty text; a null doc_id is an
id of its own kind; rows that repeat one another are rows of their own until the
exact stage; columns beside doc_id, text and source pass through, whatever their
names; a very long text is worked whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import exact_dedup, mixing, near_dup, packing, toxicity
from vecloom.llm.common import Scratch, made, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled rows among ``docs``, does not reject.

    Without labels nothing is rejected; a text without a match never is.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, null last; of rows that repeat it, one."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id; texts without words are each a class."""
    return near_dup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0 to 2 times; texts without words go; a null source is one of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows with their places in sequences, each copy of a row on its own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A grammar fitted to labels, MinHash and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = made()
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
