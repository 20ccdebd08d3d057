"""Corpus pipeline: toxicity, quality, near duplicates, mixing and packing, one after the other.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before kept. All but the last return the columns of ``docs``; the last
returns packed pieces. ``run`` writes each stage's result as Parquet in the
shared folder and reads it back, so a lost executor never repeats an earlier
stage and the scan order that packing relies on is stored.

All stages read whole texts of any length, treat repeated rows as rows of their
own, keep further columns whatever their names (they travel in one struct), and
give an empty table for an empty one. What each does with nulls, empty texts
and ties is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acurail.llm import mixing, packing, rule_ensemble, simhash, toxicity
from acurail.llm.common import prepare, staged, table
from acurail.llm.queries import word_tokenizer


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _bare(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, so that no column of ``docs`` can clash with a result column."""
    return docs.select("doc_id", "text", F.struct(*_columns(docs)).alias("row"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; learned on this stage's input.

    Null and empty texts score the labelled share of toxic documents; a score of
    the threshold is rejected. Without a toxic label nothing is rejected.
    """
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_bare(docs), model).filter("predicted = 0").select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; learned on this stage's input.

    Null and empty texts have all statistics zero and are judged by the rules; a
    score of the threshold is kept. Without labels nothing is rejected.
    """
    prepare(spark)
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(_bare(docs), model).filter("predicted = 1").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest id.

    Null and empty texts are one component. Of rows that repeat the smallest id
    one stays; a component without any id keeps one of its rows.
    """
    prepare(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    Null and empty texts hold no word and are taken once; a null source is a
    source of its own; ties between documents of one size go by hashed id.
    """
    prepare(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences.

    A null or empty text is its end id alone; a null id stays null; documents
    follow each other in their stored order.
    """
    prepare(spark)
    return packing.pack(docs, word_tokenizer())


STAGES = [("toxicity", clean), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed),
          ("packing", packed)]

#: SQL cannot express the learned stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
