"""Corpus pipeline: documents to training shards.

STAGES, in order: rejects of the quality classifier go; one document of each group of near duplicates (op1's anchor points on five-word shingles, then an exact check at similarity 0.8) stays; documents that
hold a benchmark passage go; sources are mixed to their target weights, by the classifier's score within a source (a document may come several times, or not at all); what is left
is dealt into shards. Each stage works on all rows that the one before kept and returns the columns of documents, but for the last,
which returns the shard and slot of each row. Null and empty texts, repeated rows and empty tables go through all stages as their operators
define. No SQL equivalent: the classifier, the fingerprints and the ring's hash can't be written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import near_copies, op1_simhash, op2_decontaminate, op3_mix, op5_quality, op9_shard
from topicloom.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_simhash.keep_one(docs, groups=near_copies.near_copies, prints=near_copies.prints)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Between stages there is no column for the score, so the trees are fitted again, on what is left of the labelled rows, and score what is mixed."""
    model = op5_quality.train(docs, table(spark, sf_dir, "labels"))
    return op3_mix.sample(docs, op5_quality.scorer(model, F.col("text")))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_shard.stage(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mix", mixed),
    ("shards", sharded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Between stages the rows are written once, so that no stage is computed again for the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
