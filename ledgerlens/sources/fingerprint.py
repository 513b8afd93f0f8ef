"""Dataset fingerprint (S5), order independent.

``sum(xxhash64(row))`` as an exact decimal plus the row count: a partial
aggregate, so it scales and does not depend on partitioning or row order.
(``bit_xor`` would cancel equal rows to zero, so it is not used.)
The short hex form names the dataset version behind each figure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    agg = df.agg(F.sum(h.cast("decimal(38,0)")).alias("_s"), F.count(F.lit(1)).alias("n_rows"))
    return agg.select(
        F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.col("_s").cast("string"), F.lit("0")),
                                        F.col("n_rows").cast("string")), 256), 1, 12)
        .alias("fingerprint"),
        "n_rows", F.col("_s").cast("string").alias("hash_sum"))
