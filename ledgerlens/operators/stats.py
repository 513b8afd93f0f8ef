"""Universe statistics: entity direct-award rates (A3), percentile
thresholds (A4), the threshold table (A5), data-quality counts (A6), the
entity lookup (J1) and scalar thresholds on rows (J2)."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from .quantile import percentile_scalars


def entity_stats(derived: DataFrame) -> DataFrame:
    """A3: per non-null entity, share of direct awards and row count.

    A partial (map-side) aggregate, so a hot entity costs no more than a
    cold one.  The null entity is excluded, as pandas drops null keys.
    """
    return (derived.where(F.col("entity").isNotNull())
            .groupBy("entity")
            .agg(F.avg("is_direct").alias("entity_direct_rate"),
                 F.count(F.lit(1)).alias("entity_contracts")))


@dataclass(frozen=True)
class Thresholds:
    t_value: float | None
    t_added: float | None
    t_direct: float | None
    eligible_entities: int
    total_entities: int
    n_inverted: int
    n_no_duration: int
    n_no_value: int
    n_rows: int
    median_duration: float | None
    model_rows: int
    anomaly_offset: float | None = None

    def as_row(self) -> dict:
        return asdict(self)


THRESHOLD_SCHEMA = (
    "t_value double, t_added double, t_direct double, eligible_entities bigint, "
    "total_entities bigint, n_inverted bigint, n_no_duration bigint, n_no_value bigint, "
    "n_rows bigint, median_duration double, model_rows bigint, anomaly_offset double")


def quality_counts(derived: DataFrame) -> DataFrame:
    """A6 as one global aggregate (one row)."""
    return derived.agg(
        F.count_if(F.col("dates_inverted")).alias("n_inverted"),
        F.count_if(F.col("duration_days").isNull()).alias("n_no_duration"),
        F.count_if(F.col("value").isNull()).alias("n_no_value"),
        F.count(F.lit(1)).alias("n_rows"))


def threshold_specs(params: Params = DEFAULT) -> dict:
    """Row-level percentiles of the method: p95 value, p90 positive added
    days, and the median duration used to impute it (M2)."""
    return {
        "value": (F.col("value"), params.pct_high_value),
        "added": (F.when(F.col("added_days") > 0, F.col("added_days")), params.pct_added_days),
        "duration": (F.col("duration_days"), 0.5)}


def compute_thresholds(derived: DataFrame, stats: DataFrame,
                       params: Params = DEFAULT, observed: dict | None = None) -> Thresholds:
    """A4/A5: three universe thresholds plus counts, as driver scalars.

    The row-level percentiles share the passes of one ``percentile_scalars``
    call, whose first pass may already have been observed while ``derived``
    was written; the quality counts (A6) ride along in its second pass.  The
    entity-rate percentile runs on the (much smaller) entity table.
    Nothing depends on a view.
    """
    lv = log_value(F.col("value"))
    lv_ok = lv.isNotNull() & ~F.isnan(lv) & (F.abs(lv) < F.lit(float("inf")))
    pct = percentile_scalars(derived, threshold_specs(params), first=observed, extra={
        "n_inverted": F.count_if(F.col("dates_inverted")),
        "n_no_duration": F.count_if(F.col("duration_days").isNull()),
        "n_no_value": F.count_if(F.col("value").isNull()),
        "n_rows": F.count(F.lit(1)),
        "lv_ok": F.count_if(lv_ok),
        "lv_dur_ok": F.count_if(lv_ok & F.col("duration_days").isNotNull())})
    eligible = F.col("entity_contracts") >= params.min_entity_contracts
    ent = percentile_scalars(stats, {
        "direct": (F.when(eligible, F.col("entity_direct_rate")), params.pct_direct_peers)},
        extra={"e": F.count_if(eligible), "t": F.count(F.lit(1))})
    med = pct["duration"]
    model_rows = pct["lv_ok"] if med is not None else pct["lv_dur_ok"]
    return Thresholds(pct["value"], pct["added"], ent["direct"], int(ent["e"]), int(ent["t"]),
                      int(pct["n_inverted"]), int(pct["n_no_duration"]), int(pct["n_no_value"]),
                      int(pct["n_rows"]), med, int(model_rows))


def log_value(value: Column) -> Column:
    """M1: log1p of the value clipped at 0; null stays null (``greatest``
    would turn a null into 0)."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def model_usable(derived: DataFrame, median_duration: float | None) -> Column:
    """M3: every feature present and finite after imputing the duration."""
    lv = log_value(F.col("value"))
    dur = F.coalesce(F.col("duration_days").cast("double"),
                     F.lit(median_duration).cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(lv) & finite(dur)


def thresholds_frame(spark, th: Thresholds) -> DataFrame:
    """A5 as a one-row DataFrame (bounded by construction)."""
    return spark.createDataFrame([tuple(th.as_row().values())], THRESHOLD_SCHEMA)


#: Beyond this many entities the lookup is a shuffled hash join.
MANY_ENTITIES = 1_000_000


def with_entity_stats(derived: DataFrame, stats: DataFrame, n_entities: int = 0) -> DataFrame:
    """Left lookup on entity; the null entity gets null statistics.

    ``stats`` is a stored table of one row per entity, so Spark knows its size:
    below its broadcast threshold the rows are not shuffled for the lookup;
    beyond it adaptive execution splits the partitions of a hot entity (it
    supports the streamed side of a left join).  Names often begin alike, which
    makes sorting the rows by them slow: many entities are hashed, each task
    its share of them.
    """
    return derived.join(stats.hint("shuffle_hash") if n_entities > MANY_ENTITIES else stats, "entity", "left")
