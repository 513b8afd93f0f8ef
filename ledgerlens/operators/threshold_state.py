"""Thresholds that follow the data without a rescan of the universe.

Every batch of contracts (a weekly file) leaves a small mergeable state:

* ``counts/``   the quality counts, one row;
* ``entities/`` contracts and direct awards per entity;
* ``values/``   how often each value of a measure occurs, sorted by bucket;
* ``buckets/``  how many values each bucket holds.

A bucket is a slice of the doubles: an octave in 4,096 equal parts, computed
without rounding, so buckets are in the order of their values.  Thresholds
of any set of batches come from the sums of their states: the bucket counts
tell which bucket holds a wanted rank, and only that bucket's values are
read, by a filter that the sorted files prune by.  Counts add up exactly, so
the result equals that of one pass over all rows, bit for bit.  A batch that
is replaced is just left out.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..sources import snapshot as store
from .quantile import lerp, percentile_scalars
from .stats import Thresholds, log_value, threshold_specs

PARTS = 4096
_LOWEST = 1075  # no double but 0 is nearer to 0 than 2 ** -1074

STATE = {
    "counts": ("n_inverted long, n_no_duration long, n_no_value long, n_rows long, "
               "n_log long, n_log_duration long"),
    "entities": "entity string, n long, n_direct long",
    "values": "measure string, bucket long, value double, n long",
    "buckets": "measure string, bucket long, n long",
}


#: What a state is made of.
INPUT_COLUMNS = ("entity", "value", "added_days", "duration_days", "dates_inverted", "is_direct")


def bucket(x: Column) -> Column:
    """The slice of the doubles that holds ``x``; rises with ``x``."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    unit = F.pow(F.lit(2.0), guess)
    octave = guess + F.when(a >= 2 * unit, 1).when(a < unit, -1).otherwise(0)
    part = F.floor((a / F.pow(F.lit(2.0), octave) - 1) * PARTS)  # exact: powers of two
    size = (octave + _LOWEST) * PARTS + part + 1
    most = (_LOWEST + 1025) * PARTS
    inside = F.when(a == 0, 0).when(a == float("inf"), most).when(a < 2.0 ** -1000, 1).otherwise(size)
    return F.when(x < 0, -inside).otherwise(inside).cast("long")


def write_state(derived: DataFrame, path: str, params: Params = DEFAULT) -> None:
    """Writes the state of a batch of derived contracts.

    The batch is read three times; one that is dear to compute should be stored.
    """
    spark = derived.sparkSession
    lv = log_value(F.col("value"))
    ok = lv.isNotNull() & ~F.isnan(lv) & (F.abs(lv) < float("inf"))
    derived.agg(
        F.count_if("dates_inverted").alias("n_inverted"),
        F.count_if(F.col("duration_days").isNull()).alias("n_no_duration"),
        F.count_if(F.col("value").isNull()).alias("n_no_value"), F.count("*").alias("n_rows"),
        F.count_if(ok).alias("n_log"), F.count_if(ok & F.col("duration_days").isNotNull()).alias("n_log_duration"),
    ).write.parquet(f"{path}/counts")
    derived.where("entity IS NOT NULL").groupBy("entity").agg(
        F.count("*").alias("n"), F.sum("is_direct").cast("long").alias("n_direct")).write.parquet(f"{path}/entities")
    measures = [F.struct(F.lit(name).alias("measure"), c.cast("double").alias("value"))
                for name, (c, _) in threshold_specs(params).items()]
    values = (derived.select(F.inline(F.array(*measures))).where("value IS NOT NULL AND NOT isnan(value)")
              .groupBy("measure", "value").agg(F.count("*").alias("n"))
              .withColumn("bucket", bucket(F.col("value"))))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (values.select("measure", "bucket", "value", "n").repartitionByRange(width, "measure", "bucket", "value")
     .sortWithinPartitions("measure", "bucket", "value").write.parquet(f"{path}/values"))
    (spark.read.parquet(f"{path}/values").groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
     .write.parquet(f"{path}/buckets"))


def _read(spark: SparkSession, paths: Sequence[str], part: str) -> DataFrame:
    return spark.read.schema(STATE[part]).parquet(*[f"{p}/{part}" for p in paths])


def merged_entities(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A3 over all batches: ``entity, entity_direct_rate, entity_contracts``."""
    return _read(spark, paths, "entities").groupBy("entity").agg(
        F.sum("n").alias("_n"), F.sum("n_direct").alias("_d")).select(
        "entity", (F.col("_d") / F.col("_n")).alias("entity_direct_rate"), F.col("_n").alias("entity_contracts"))


def _percentiles(spark: SparkSession, paths: Sequence[str], levels: dict[str, float]) -> dict[str, float | None]:
    """Exact percentiles of the measures from the sums of the batches' states."""
    buckets = _read(spark, paths, "buckets").groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    # Not rows but slices of the doubles: at most 2 * 2100 * PARTS for a measure.
    earlier = Window.partitionBy("measure").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("measure")
    level = F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col("measure"))
    pos = level * (F.col("_all") - 1)
    placed = (buckets.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .withColumn("_all", F.sum("n").over(every)).withColumn("_pos", pos)
              .withColumn("_rank", F.explode(F.array_distinct(F.array(
                  F.floor("_pos"), F.least(F.floor("_pos") + 1, F.col("_all") - 1)))))
              .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("n"))))
    wanted = placed.select("measure", "bucket", "_before", "_rank", "_pos").collect()  # two of each measure
    if not wanted:
        return dict.fromkeys(levels)
    here = reduce(lambda a, b: a | b, [
        (F.col("measure") == w["measure"]) & (F.col("bucket") == w["bucket"]) for w in wanted])
    run = Window.partitionBy("measure", "bucket").orderBy("value")
    upto = (_read(spark, paths, "values").where(here).groupBy("measure", "bucket", "value")
            .agg(F.sum("n").alias("n")).withColumn("_upto", F.sum("n").over(run)))
    picks = [F.min(F.when((F.col("measure") == w["measure"]) & (F.col("bucket") == w["bucket"])
                          & (F.col("_upto") > w["_rank"] - w["_before"]), F.col("value"))).alias(f"v{k}")
             for k, w in enumerate(wanted)]
    got = upto.agg(*picks).first()
    out: dict[str, float | None] = dict.fromkeys(levels)
    for name in levels:
        mine = sorted((w["_rank"], got[f"v{k}"], w["_pos"]) for k, w in enumerate(wanted) if w["measure"] == name)
        if mine:
            out[name] = lerp(mine[0][1], mine[-1][1], mine[0][2] - math.floor(mine[0][2]))
    return out


def thresholds_of(spark: SparkSession, paths: Sequence[str], params: Params = DEFAULT) -> Thresholds:
    """The thresholds of all rows whose states lie at ``paths``."""
    c = _read(spark, paths, "counts").agg(*[
        F.coalesce(F.sum(x.split()[0]), F.lit(0)).alias(x.split()[0]) for x in STATE["counts"].split(", ")]).first()
    pct = _percentiles(spark, paths, {name: p for name, (_, p) in threshold_specs(params).items()})
    eligible = F.col("entity_contracts") >= params.min_entity_contracts
    ent = percentile_scalars(merged_entities(spark, paths), {
        "direct": (F.when(eligible, F.col("entity_direct_rate")), params.pct_direct_peers)},
        extra={"e": F.count_if(eligible), "t": F.count("*")})
    model_rows = c["n_log"] if pct["duration"] is not None else c["n_log_duration"]
    return Thresholds(pct["value"], pct["added"], ent["direct"], int(ent["e"]), int(ent["t"]),
                      int(c["n_inverted"]), int(c["n_no_duration"]), int(c["n_no_value"]), int(c["n_rows"]),
                      pct["duration"], int(model_rows))


class ThresholdStore:
    """States of named batches in a shared folder.

    A state is written under a fresh name and then pointed to, so a failed or
    repeated ``add`` leaves the batch as it was.
    """

    def __init__(self, spark: SparkSession, base: str, params: Params = DEFAULT):
        self.spark, self.base, self.params = spark, base.rstrip("/"), params

    def add(self, batch: str, derived: DataFrame) -> None:
        """Adds a batch, or replaces it."""
        path = f"{self.base}/{batch}/state-{uuid.uuid4().hex[:12]}"
        write_state(derived, path, self.params)
        store.publish(self.spark, f"{self.base}/{batch}", path)

    def has(self, batch: str) -> bool:
        return store.current_attempt(self.spark, f"{self.base}/{batch}") is not None

    def thresholds(self, batches: Sequence[str]) -> Thresholds:
        paths = [store.current_attempt(self.spark, f"{self.base}/{b}") for b in batches]
        if None in paths:
            raise KeyError(f"no state of batch {batches[paths.index(None)]!r}")
        return thresholds_of(self.spark, paths, self.params)
