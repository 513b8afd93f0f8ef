"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_position
from ..session import cut, ship_package, work_dir
from ..sources.snapshot import remove

__all__ = ["WORD", "clear_scratch", "cut", "ready", "scratch", "shuffle_width", "table",
           "with_position", "word_count"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with a shared folder and this package on the executors."""
    spark = df.sparkSession
    work_dir(spark)
    ship_package(spark)
    return spark


def word_count(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared work folder for a table that a result is read from."""
    _SCRATCH.append(f"{work_dir(spark)}/llm-scratch/{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables of this session; to be called when its results are written."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())
