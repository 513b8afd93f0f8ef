"""Manifest of the input files: what a figure was computed from.

For every input file the manifest holds its table (origin), size, time and
an order-independent hash and count of its rows.  The sum over all files is
the dataset version: it names the content, whichever way the rows lie in
files, and keys the snapshot.  The manifest is a table in the shared work
folder that only grows; files that it knows by name, size and time are not
read again, so a weekly file costs its own scan.

Nothing is gathered per file on the driver: a listing is reduced to one row
by an order-independent hash.  The names of new files go through the driver
only while they are few (``FEW_FILES``); beyond that all files are hashed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

FEW_FILES = 10_000

SCHEMA = ("origin string, file string, bytes long, modified timestamp, n_rows long, "
          "hash_sum decimal(38,0)")
_KEY = ["origin", "file", "bytes", "modified"]


def origin_of(path: str) -> str:
    """The table's name: the last part of its path."""
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")


def listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``origin, file, bytes, modified`` of the input files; contents are not read."""
    parts = [spark.read.format("binaryFile").load(p).select(
        F.lit(origin_of(p)).alias("origin"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified")) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def _sum(hash64: Column) -> Column:
    return F.coalesce(F.sum(hash64.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")


def _short(*cols: Column) -> Column:
    """Twelve hex digits of some values."""
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256), 1, 12)


def listing_key(files: DataFrame) -> str:
    """Names a state of the input files by name, size and time: one row of one job."""
    return files.agg(_sum(F.xxhash64(*_KEY)).alias("s"), F.count("*").alias("n")).select(
        _short(F.col("s"), F.col("n"))).first()[0]


def file_hashes(spark: SparkSession, path: str, columns: Sequence[str] = (),
                files: Sequence[str] = ()) -> DataFrame:
    """``file, n_rows, hash_sum`` of a table's files, or of some; a partial aggregate.

    ``columns``: those that the figures depend on; all by default.  (A sum of
    hashes, as ``bit_xor`` would cancel equal rows.)
    """
    table = spark.read.parquet(path)
    if files:
        table = table.where(F.col("_metadata.file_path").isin(list(files)))
    used = [F.col(f"`{c}`") for c in (columns or table.columns)]
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n_rows"), _sum(F.xxhash64(*used)).alias("hash_sum"))


def _store(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/ledgerlens/manifest"


def known_files(spark: SparkSession) -> DataFrame:
    from .snapshot import exists
    if not exists(spark, _store(spark)):
        return spark.createDataFrame([], SCHEMA)
    # Two refreshes at once may both have added a file: with the same values.
    return spark.read.schema(SCHEMA).parquet(_store(spark)).dropDuplicates(_KEY)


def refresh(spark: SparkSession, paths: Sequence[str],
            columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The manifest of the files that now lie at ``paths``; new files are hashed and added."""
    now = listing(spark, paths)
    new = now.join(known_files(spark), _KEY, "left_anti")
    some = new.select("origin", "file").limit(FEW_FILES + 1).collect()
    if some:
        parts = []
        for p in paths:
            mine = [r["file"] for r in some if r["origin"] == origin_of(p)]
            if mine or len(some) > FEW_FILES:
                parts.append(file_hashes(spark, p, (columns or {}).get(origin_of(p), ()),
                                         mine if len(some) <= FEW_FILES else ()))
        hashes = reduce(DataFrame.unionByName, parts)
        # A file without rows has no group of its own.
        added = new.join(hashes, "file", "left").fillna(0, ["n_rows"]).withColumn(
            "hash_sum", F.coalesce("hash_sum", F.lit(0).cast("decimal(38,0)")))
        added.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(_store(spark))
    return now.join(known_files(spark), _KEY)


def dataset_version(files: DataFrame) -> DataFrame:
    """One row per table of a manifest: ``origin, n_files, bytes, n_rows, fingerprint, version``.

    ``fingerprint`` names the content of the table, ``version`` that of all of them.
    """
    per = files.groupBy("origin").agg(
        F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"),
        F.sum("hash_sum").cast("decimal(38,0)").alias("_s"))
    per = per.withColumn("fingerprint", _short(F.col("_s"), F.col("n_rows")))
    every = per.agg(_sum(F.xxhash64("origin", "fingerprint")).alias("_v"))  # one row per table
    version = every.select(_short(F.col("_v")).alias("version"))
    return per.drop("_s").withColumn("version", version.scalar())


_VERSIONS: dict[tuple, str] = {}


def version_of(spark: SparkSession, paths: Sequence[str],
               columns: Mapping[str, Sequence[str]] | None = None) -> str:
    """The dataset version of the files at ``paths``.

    The listing is taken on every call, so changed files are noticed; the
    manifest is consulted only for a listing that this session has not seen.
    """
    key = (work_dir(spark), listing_key(listing(spark, paths)), tuple(sorted((columns or {}).items())))
    if key not in _VERSIONS:
        _VERSIONS[key] = dataset_version(refresh(spark, paths, columns)).agg(F.max("version")).first()[0]
    return _VERSIONS[key]
