"""From raw documents to packed training sequences: five stages, each written and read again by whoever runs them.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, line_templates, mixing, packing, toxicity
from tessera.llm.common import fresh, shared_dir, table
from tessera.llm.graphs import without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.reject(spark, docs, sf_dir)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of recurring templates; n_chars follows the text."""
    lines, gone = fresh("lines"), fresh("gone")
    out = line_templates.dedup(docs, n_lines=lines, n_dropped=gone)
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that with the smallest doc_id. Rows with
    one doc_id stay or go together; a null id goes where its group has another."""
    groups = jaccard_join.joined(docs, n=5, num=80, den=100)
    return without(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), "doc_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each time a document is used."""
    return mixing.curriculum(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and places in sequences."""
    return packing.sequences(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages train a classifier, parse templates, follow links and tokenize; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
