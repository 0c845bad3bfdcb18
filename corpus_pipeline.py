"""From raw documents to token ids: five stages, each of which works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and read again.
All but the last return the columns of documents.

- quality_rules rejects documents that fail the base rules or the boosted trees.
- quality_classifier rejects documents that the classifier predicts to be of label 0.
- near_dedup keeps the document with the smallest doc_id of each group of near-duplicates, and of rows that repeat a
  doc_id one.
- source_mix repeats or leaves out documents so that the sources meet their target weights. A document that is taken
  twice has two rows.
- byte_bpe encodes each text, and decodes the ids again.

Null texts and sources, empty tables and further columns pass through: a null text fails the base rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewright.llm import bpe, common, mixing, nbsvm, quality_trees, queries, setsketch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    trees = quality_trees.learn(docs, _labels(spark, sf_dir))
    return quality_trees.score(docs, trees, COLUMNS).where("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    model = nbsvm.learn(docs, _labels(spark, sf_dir))
    return nbsvm.score(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return setsketch.without_near_duplicates(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return mixing.mix(docs).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    import public_tokenizers

    model = queries.ranked_model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return queries.coded(docs, model, ["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The fitted trees and the classifier can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
