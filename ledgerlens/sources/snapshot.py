"""Versioned snapshot store in the shared work folder.

A snapshot is written once per (dataset version, parameters) and read by
every view.  Each build writes a fresh ``attempt-<id>/`` folder under
``<spark.checkpoint.dir>/ledgerlens/<key>/`` and publishes it by adding a
row to the ``current/`` pointer table last, so readers never see a partial
attempt nor a gap, and concurrent builds never share files.  An attempt
holds:

* ``derived/``      derived columns (lineage cut before the multi-pass stats);
  removed when the build is complete
* ``entity_stats/`` one row per entity
* ``rows/``         enriched rows, partitioned by ``sign_year``
* ``grams/``        trigram postings of the rows' search text
* ``thresholds/``   one row; written last, so its presence marks completion

All writes are Spark jobs (task retries and lost executors are handled by
the output commit protocol); nothing is kept on a machine-local disk.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir


def snapshot_key(version: str, params_key: str, code_version: str) -> str:
    """Folder name of what is computed from a dataset version with some parameters."""
    return hashlib.sha256("|".join((version, params_key, code_version)).encode()).hexdigest()[:16]


def snapshot_dir(spark: SparkSession, key: str) -> str:
    return f"{work_dir(spark)}/ledgerlens/{key}"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a folder at ``path``, on whichever file system it names?"""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Bounds of the row groups (bytes, before compression).  A scan task is
# assigned whole row groups, so big ones in few files would leave most tasks
# of a Python stage idle; in a large snapshot small ones only cost footers.
ROW_GROUP_BYTES = 8 * 1024 * 1024
MAX_ROW_GROUP_BYTES = 128 * 1024 * 1024


def row_group_bytes(spark: SparkSession, input_bytes: int) -> int:
    """Row groups of which every core gets several."""
    share = input_bytes // (8 * max(1, spark.sparkContext.defaultParallelism))
    return min(MAX_ROW_GROUP_BYTES, max(ROW_GROUP_BYTES, share))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  row_group: int = ROW_GROUP_BYTES, unlike: Sequence[str] = ()) -> None:
    """``unlike``: texts that hardly repeat, so that a dictionary would be begun in
    every row group and dropped again."""
    w = df.write.mode("overwrite").option("parquet.block.size", row_group)
    for c in unlike:
        w = w.option(f"parquet.enable.dictionary#{c}", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


_POINTERS = "path string, at double"
KEEP_ATTEMPTS = 2  # the newest, and the one that readers may still be using


def publish(spark: SparkSession, base: str, attempt: str) -> None:
    """Adds a pointer to a complete attempt; readers follow the newest.

    Pointers are only ever added, so there is no moment without one.  Attempts
    that are no longer among the newest are removed.
    """
    (spark.createDataFrame([(attempt, time.time())], _POINTERS).coalesce(1)
     .write.mode("append").parquet(f"{base}/current"))
    for old in _attempts(spark, base)[KEEP_ATTEMPTS:]:
        if exists(spark, old):
            remove(spark, old)


def _attempts(spark: SparkSession, base: str) -> list[str]:
    """Published attempts, newest first (one row for each build of this key)."""
    if not exists(spark, f"{base}/current"):
        return []
    found = spark.read.schema(_POINTERS).parquet(f"{base}/current").groupBy("path").agg(F.max("at").alias("at"))
    return [r["path"] for r in found.orderBy(F.desc("at"), F.desc("path")).collect()]


def current_attempt(spark: SparkSession, base: str) -> str | None:
    """The newest published attempt, if there is one."""
    return next(iter(_attempts(spark, base)), None)
