"""From raw documents to packed sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
to the shared folder and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``, whatever further columns these
have; names of helper columns do not clash with them.

Null and empty texts go at the quality rules, null sources are a source of
their own, null doc_ids stay documents.  Rows that repeat a text, under one
doc_id or several, are one document after the near copies are removed.  Very
long texts are read whole and packed in pieces; a piece names its text by
``text_md5``, so pieces of equal or null doc_ids can be told apart.  An
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import mixing, near_join, packing, quality, toxicity
from ledgerlens.llm._common import clear_scratch, table
from ledgerlens.session import work_dir
from ledgerlens.sources.snapshot import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their bins."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _after_writing(stage: Stage) -> Stage:
    """The stage; its ``docs`` are a written table, so what the stage before worked with goes first."""
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark)
        return stage(spark, docs, sf_dir)
    return apply


STAGES = [(name, _after_writing(stage)) for name, stage in (
    ("toxicity", drop_toxic), ("quality rules", keep_good), ("n-gram Jaccard join", one_of_each),
    ("mixing", mix), ("best-fit packing", pack))]

#: A learned filter, a divergence of corpus profiles and a greedy packing are
#: not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_scratch(spark)
        if k:  # its only reader is done
            remove(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
