"""Sharding by rendezvous hashing of stable record keys.

Every (key, shard) pair has a pseudo-random score ``-weight / ln(u)``; a
record belongs to the shard of its highest score.  A new shard can only win
records for itself, so growing by one shard moves just those.

Null keys are one key of their own; null texts count no bytes; rows with
equal keys go to the same shard and get slots of their own.  Texts of any
length are read whole.  An empty table
gives an empty result.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ready, with_position

SHARDS = 24
OVERHEAD = 8  # bytes a record takes besides its text


def _named(key: str) -> Column:
    """The key as text; a null key is like no other."""
    return F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Positive score; larger wins.  u has 52 bits and is never 0 or 1."""
    digest = F.md5(F.concat(F.lit("shard:"), shard.cast("string"), F.lit(":"), key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -weight / F.log(u)


def _best(key: Column, weights: Sequence[float]) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = F.transform(table, lambda w, s: F.struct(
        _score(key, s, w).alias("score"), (-s).alias("neg")))
    return F.array_max(ranked)


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS,
                  weights: Sequence[float] | None = None) -> DataFrame:
    """Adds ``shard`` and ``grown_shard``, the shard with one more of weight 1.

    ``weights``: the shards' capacities, equal by default.
    """
    weights = list(weights or [1.0] * shards)
    last = _score(F.col("_key"), F.lit(len(weights)), F.lit(1.0))
    return (df.withColumn("_key", _named(key)).withColumn("_best", _best(F.col("_key"), weights))
            .withColumn("shard", (-F.col("_best.neg")).cast("int"))
            .withColumn("grown_shard", F.when(last > F.col("_best.score"), F.lit(len(weights)))
                        .otherwise(F.col("shard")).cast("int"))
            .drop("_key", "_best"))


def shard_slots(docs: DataFrame, shards: int = SHARDS,
                weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document with its shard and its gapless slot in the shard.

    Slots follow a hash of the key, so a shard's rows are mixed.
    """
    ready(docs)
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(data).cast("long").alias("text_crc32"))
    order = [F.md5(F.concat(F.lit("slot:"), _named("doc_id"))), F.col("doc_id").asc_nulls_first(),
             F.col("text_crc32"), F.col("size")]
    placed = with_position(assign_shards(rows, "doc_id", shards, weights), ["shard"], order)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("pos") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4,
                 weights: Sequence[float] | None = None) -> None:
    """Writes every record into the folder ``shard=N`` of its shard, in ``files`` files each."""
    piece = F.pmod(F.xxhash64(F.lit("file"), _named("doc_id")), F.lit(files))
    placed = assign_shards(docs, "doc_id", shards, weights).drop("grown_shard")
    (placed.repartition(shards * files, "shard", piece)
     .write.mode("overwrite").partitionBy("shard").parquet(path))
