"""From documents to token ids: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last
gives token ids. run() writes every stage's rows to the shared folder and reads them for the next.

Defined cases, for every stage: a null text counts as empty (the language stage rejects it, as it has no
letter); a null id or source is one like any other; rows that repeat an id, or have none, are rows of
their own, told apart by their place in the order of id, length and reading; of equal rows the dedup stages
keep one; very long texts are taken whole; an empty table gives an empty one; columns beyond those of
documents are carried as they are, whatever their names; a table without any labelled language keeps all
documents that have a letter. The near stage takes five-word shingles and a similarity of 0.8, the rule
for near duplicates that no contract fixes; copies below that similarity are meant to stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from paperlode.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage):
    """Columns that documents doesn't have go through the stage under names that clash with nothing."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@_carrying
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter and those whose language is ambiguous."""
    model = language_id.train_language_model(docs)
    if not model.languages:  # nothing is known of languages, so none can be rejected
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, carry=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & ~F.col("lang_ambiguous"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a row_key of each row's own in the order of the ids (null last, then the longest text first):
    the id itself, or where ids repeat or are null the place in that order, written so that it stays."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    rows = docs.withColumn("row_read", F.monotonically_increasing_id())  # the last key, so no id fills a partition
    rows = rows.orderBy(F.asc_nulls_last("doc_id"), F.desc(F.length("text")), "row_read").drop("row_read")
    return written(rows.withColumn("row_key", F.monotonically_increasing_id()), "keyed")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(dropped.select(F.col("id").alias("row_key")), "row_key", "left_anti")


@_carrying
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, also where rows repeat an id or have none."""
    docs = _keyed(docs)
    found = written(exact_dedup.exact_dedup(docs, id_col="row_key"), "exact")
    return _without(docs, found.filter("NOT kept"))


@_carrying
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group (five-word shingles, similarity 0.8), also where
    rows repeat an id or have none."""
    docs = _keyed(docs)
    found = jaccard_join.near_duplicates(docs, id_col="row_key")
    return _without(docs, found.filter("id <> component_id"))


@_carrying
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources have their target weights, and shuffles."""
    return mixing.mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("mix_sources", mix), ("bpe", tokens)]
#: SQL can express neither the classifier nor the encoding; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
