"""A corpus pipeline of five stages over ``documents``; each calls one operator of this subpackage.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All
but the last return the columns of documents. A stage's output is written as Parquet and read
again as the next one's input; what a stage wrote for itself is removed then.

Defined cases, for each stage: a null text is an empty one, a null id is kept like any other, a null
source is a source of its own; repeated rows are rows of their own, but copies of each other in
near-dedup, where one stays; columns beyond doc_id, text and source go along unread, whatever their
names; very long texts are read whole; ties are broken as the operator called says; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import mixing, near_copies, packing, quality, toxicity
from inkwell.llm.shared import discard, materialize, passing, table
from inkwell.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that probably have any grade but the lowest."""
    ship(spark)
    return quality.keep_selected(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a Jaccard index of 0.8 on five-word shingles links, directly or through others, the one with the least id."""
    ship(spark)
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the classifiers nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            kept = keep(materialize(stage(spark, docs, sf_dir), name.split()[0]))
        discard(docs)  # tables of documents that weren't written here stay
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
