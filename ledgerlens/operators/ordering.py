"""Positions in a global order without a one-task window.

A window without partition, or over one hot group, sorts everything in one
task.  Here rows are dealt by ranges of (group, order), sorted inside each
range and numbered there; a small table of counts per range and group shifts
the numbers.  Equal rows are told apart by where they were read, so no run of
ties fills a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  out: str = "pos") -> DataFrame:
    """Adds the 1-based position of each row within its group, in ``order``.

    ``group`` columns must not be null.  Rows equal in ``order`` get
    neighbouring positions in any order, so ``order`` should hold every column
    in which rows that matter differ.  The ranges are written once, which pins
    them: after a lost executor the same ranges are read again.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group]
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    dealt = cut(salted.repartitionByRange(width, *keys, *order, F.col("_salt"))
                .sortWithinPartitions(*keys, *order, F.col("_salt")).drop("_salt")
                .withColumn("_at", F.monotonically_increasing_id()))  # range, then row in it
    dealt = dealt.withColumn("_range", F.shiftrightunsigned("_at", 33))
    by = ["_range", *group]
    counts = dealt.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)  # at most one row for each range and group
    shift = counts.select(*by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
                                + 1).alias("_shift"))
    return (dealt.join(shift, by).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long"))
            .drop("_at", "_range", "_shift"))
