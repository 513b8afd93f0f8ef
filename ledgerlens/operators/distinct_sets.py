"""Sets of ids as mergeable bitmaps (A1, A2 for any view).

A count of distinct ids can't be added up: the contracts of two years may
overlap.  Here every id gets a dense number, and a set of ids is a few
bitmaps of 32,768 bits, one for each bucket of numbers that it touches.  Bitmaps
are built with a partial aggregate (a task sends at most one of a bucket),
any sets are united by OR, and a count is the number of bits.

Dense sets (years, bands, views) shrink to a bit an id; for keys with few
ids each, such as entities, ``count(distinct)`` is smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_position

MEMBERS = "bucket long, bits binary"


def dense_numbers(rows: DataFrame, column: str) -> DataFrame:
    """``column, number``: the distinct ids that are not null, numbered from 0 in their order."""
    ids = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return with_position(ids, [], [F.col(column)], out="number").withColumn("number", F.col("number") - 1)


def number_rows(rows: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """Adds ``number`` to the rows with a known id; adaptive execution splits a hot id."""
    return rows.join(numbers, column)


def bitmaps(numbered: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, bucket, bits``: the set of numbers of each group."""
    number = F.col("number")
    return numbered.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def united(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of the sets of each group."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    """Number of ids in the set of each group; ``sets`` holds a bucket of a group once."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))


def repeated(numbered: DataFrame, by: Sequence[str], out: str = "n_repeated") -> DataFrame:
    """How many ids stand on more than one row of a group (A2): bits that a second row sets again."""
    per = numbered.groupBy(*by, "number").agg(F.count("*").alias("_c")).where("_c > 1")
    return sizes(bitmaps(per, by), by, out)
