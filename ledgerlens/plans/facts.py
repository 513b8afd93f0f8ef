"""Layer 2 facts: what each view shows.

Every function takes the rows of a view ``f`` (already filtered) and
returns a small DataFrame.  Aggregations are partial (map-side) and run on
the pruned snapshot columns; top-N lists use ``orderBy().limit()``
(TakeOrderedAndProject), and windows run only over grouped or limited
tables.  Money sums are exact decimals, so results do not depend on the
order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (LIST_SIZE, MIN_MEDIAN_GROUP, SLICE_LABEL_MIN_PCT, TOP_MODALITIES,
                      TOP_N)
from ..functions import formats as fm
from ..operators.ordering import with_position
from ..operators.quantile import percentile_exact, percentile_value
from ..operators.report import (attach_one_row, cumulative, first_flag, money_sum, short_labels,
                                top_n_with_other, unique_short_labels)


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


# --------------------------------------------------------------------------
# KPI row
# --------------------------------------------------------------------------
def _flag_count(f: DataFrame) -> list:
    """The number of anomalous rows, where the view has the model's flag."""
    return [F.count_if(F.col("is_anomaly")).alias("n_anomalies")] if "is_anomaly" in f.columns else []


def kpis(f: DataFrame) -> DataFrame:
    """One row: counts, money, means, median, SME share, rule counts, anomalies."""
    flagged = _flag_count(f)
    base = f.agg(
        *flagged,
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("contract_id").alias("n_contracts"),
        F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value"),
        F.count("value").alias("n_values"),
        F.sum("duration_days").alias("_dur_sum"),
        F.count("duration_days").alias("_dur_n"),
        F.count_if(F.col("is_sme")).alias("_sme"),
        F.count("is_sme").alias("_sme_n"),
        F.count_if(F.col("signals") >= 2).alias("n_priority"),
        F.count_if(F.col("signals") == 3).alias("n_critical"))
    median = percentile_value(f, "value", 0.5)
    mean = F.when(F.col("n_values") > 0, _ratio(F.col("total_value"), F.col("n_values")))
    return base.select(
        "n_rows", "n_contracts", (F.col("n_rows") != F.col("n_contracts")).alias("has_duplicates"),
        "total_value", mean.alias("mean_value"),
        F.lit(median).cast("double").alias("median_value"),
        _ratio(F.col("_dur_sum"), F.col("_dur_n")).alias("mean_duration"),
        (_ratio(F.col("_sme"), F.col("_sme_n")) * 100).alias("sme_pct"),
        "n_priority", "n_critical",
        (_ratio(F.col("n_priority"), F.col("n_rows")) * 100).alias("priority_pct"),
        F.coalesce((F.lit(median) > 0) & (mean > F.lit(median) * 2), F.lit(False))
        .alias("mean_inflated"),
        *(["n_anomalies", (_ratio(F.col("n_anomalies"), F.col("n_rows")) * 100).alias("anomaly_pct")]
          if flagged else []))


def duplicates(f: DataFrame) -> DataFrame:
    """A2: ids that occur on more than one row, with their row counts."""
    return (f.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


# --------------------------------------------------------------------------
# A7 + W4: top entities by value
# --------------------------------------------------------------------------
def top_entities(f: DataFrame, n: int = TOP_N, label_len: int = 38) -> DataFrame:
    total = f.agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("view_total"))
    per = (f.where(F.col("entity").isNotNull()).groupBy("entity")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value")))
    top = (per.orderBy(F.desc("total_value"), "entity").limit(n)
           .withColumn("rank", F.row_number().over(
               Window.orderBy(F.desc("total_value"), "entity")).cast("bigint")))
    top = unique_short_labels(top, "entity", "rank", label_len)
    return (attach_one_row(top, total)
            .select("rank", "entity", "label", "total_value",
                    (F.col("total_value") / 1e9).alias("total_bn"),
                    (_ratio(F.col("total_value"), F.col("view_total")) * 100).alias("share_pct"),
                    fm.percent(F.col("total_value"), F.col("view_total")).alias("share_text")))


# --------------------------------------------------------------------------
# A8 + T4 + U1: modality mix
# --------------------------------------------------------------------------
def modality_mix(f: DataFrame, n: int = TOP_MODALITIES) -> DataFrame:
    counts = (f.where(F.col("modality").isNotNull()).groupBy("modality")
              .agg(F.count(F.lit(1)).alias("n_rows")))
    mix = top_n_with_other(counts, "modality", "n_rows", n,
                           [F.desc("n_rows"), F.col("modality")])
    tot = Window.partitionBy(F.lit(1))
    share = F.col("n_rows") / F.sum("n_rows").over(tot) * 100
    return (mix.withColumn("share_pct", share)
            .withColumn("slice_label", F.when(F.col("share_pct") >= SLICE_LABEL_MIN_PCT,
                                              fm.share_text(F.col("share_pct")))
                        .otherwise(F.lit(""))))


# --------------------------------------------------------------------------
# A9 + W2: value by signing year
# --------------------------------------------------------------------------
def yearly_value(f: DataFrame) -> DataFrame:
    per = (f.where(F.col("signed_at").isNotNull()).groupBy("sign_year")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value")))
    pos = per.where(F.col("total_value") > 0)
    w = Window.orderBy("sign_year")
    pos = (pos.withColumn("prev_year", F.lag("sign_year").over(w))
           .withColumn("prev_total", F.lag("total_value").over(w))
           .withColumn("is_peak", first_flag([F.desc("total_value"), F.col("sign_year")]))
           .withColumn("is_last", F.row_number().over(Window.orderBy(F.desc("sign_year"))) == 1)
           .select("sign_year", "prev_year", "prev_total", "is_peak", "is_last"))
    change = F.when(F.col("prev_total") != 0,
                    (F.col("total_value") - F.col("prev_total")) / F.col("prev_total") * 100)
    return (per.join(pos, "sign_year", "left")
            .select(F.col("sign_year").cast("bigint").alias("sign_year"), "total_value",
                    (F.col("total_value") / 1e9).alias("total_bn"),
                    (F.col("total_value") > 0).alias("in_reading"),
                    F.col("prev_year").cast("bigint").alias("prev_year"),
                    change.alias("change_pct"),
                    F.coalesce("is_peak", F.lit(False)).alias("is_peak"),
                    F.coalesce("is_last", F.lit(False)).alias("is_last")))


# --------------------------------------------------------------------------
# A10: median value by modality
# --------------------------------------------------------------------------
def median_by_modality(f: DataFrame, n: int = TOP_N, min_n: int = MIN_MEDIAN_GROUP,
                       label_len: int = 22) -> DataFrame:
    g = f.where(F.col("modality").isNotNull())
    counts = g.groupBy("modality").agg(F.count("value").alias("n_values"))
    med = percentile_exact(g, "value", 0.5, by=["modality"], out="median_value")
    ok = counts.join(med, "modality", "left").where(F.col("n_values") >= min_n)
    ranked = with_position(ok, [], [F.desc("median_value"), F.col("modality")], out="rank")
    # The last of the least: ties go to the greater name.
    least = ok.agg(F.min("median_value").alias("_least"))
    low = attach_one_row(ok, least).where("median_value = _least").agg(F.max("modality").alias("_low"))
    top = attach_one_row(short_labels(ranked, "modality", "rank", label_len), low)
    return top.select("rank", "modality", "label", "n_values", "median_value",
                      (F.col("median_value") / 1e6).alias("median_m"),
                      (F.col("rank") <= n).alias("in_chart"),
                      (F.col("modality") == F.col("_low")).alias("is_lowest"))


# --------------------------------------------------------------------------
# A11 + W5: SME share by value band
# --------------------------------------------------------------------------
def sme_by_band(f: DataFrame) -> DataFrame:
    overall = f.agg((_ratio(F.count_if(F.col("is_sme")), F.count("is_sme")) * 100)
                    .alias("overall_sme_pct"))
    per = (f.where(F.col("value_band").isNotNull())
           .groupBy("value_band", "value_band_label")
           .agg((_ratio(F.count_if(F.col("is_sme")), F.count("is_sme")) * 100).alias("sme_pct"))
           .where(F.col("sme_pct").isNotNull()))
    return (per.withColumn("non_sme_pct", 100 - F.col("sme_pct"))
            .withColumn("is_highest", first_flag([F.desc("sme_pct"), F.col("value_band")]))
            .withColumn("is_lowest", first_flag([F.asc("sme_pct"), F.col("value_band")]))
            .transform(lambda d: attach_one_row(d, overall))
            .select(F.col("value_band").cast("bigint").alias("value_band"), "value_band_label",
                    "sme_pct", "non_sme_pct", "is_highest", "is_lowest", "overall_sme_pct"))


# --------------------------------------------------------------------------
# A12 + W1 + T4 + U1: supplier concentration (Pareto)
# --------------------------------------------------------------------------
def supplier_pareto(f: DataFrame, n: int = TOP_N, label_len: int = 18) -> DataFrame:
    per = (f.where(F.col("supplier").isNotNull()).groupBy("supplier")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value")))
    stats = per.agg(F.count(F.lit(1)).alias("n_suppliers"),
                    F.sum(F.col("total_value").cast("decimal(28,2)")).cast("double")
                    .alias("suppliers_total"))
    top = per.orderBy(F.desc("total_value"), "supplier").limit(n)
    top = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("total_value"), "supplier")).cast("bigint"))
    top_sum = top.agg(F.sum(F.col("total_value").cast("decimal(28,2)")).alias("_top"))
    other = (attach_one_row(stats, top_sum).where(F.col("n_suppliers") > n)
             .select(F.lit(n + 1).cast("bigint").alias("rank"), F.lit("Other").alias("supplier"),
                     (F.col("suppliers_total").cast("decimal(28,2)") - F.col("_top"))
                     .cast("double").alias("total_value")))
    rows = top.select("rank", "supplier", "total_value").unionByName(other)
    rows = unique_short_labels(rows, "supplier", "rank", label_len)
    shown = rows.agg(F.sum(F.col("total_value").cast("decimal(28,2)")).cast("double")
                     .alias("_shown"))
    out = (attach_one_row(attach_one_row(rows, shown), stats)
           .withColumn("pct", _ratio(F.col("total_value"), F.col("_shown")) * 100))
    return out.select("rank", "supplier", "label", "total_value", "pct",
                      cumulative("pct").alias("cum_pct"), "n_suppliers",
                      (F.col("rank") > n).alias("is_other"))


# --------------------------------------------------------------------------
# Headline facts
# --------------------------------------------------------------------------
def headline(f: DataFrame, n: int = TOP_N) -> DataFrame:
    """One row with the view's headline numbers and which clauses apply."""
    flagged = _flag_count(f)
    base = f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("contract_id").alias("n_contracts"),
        F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value"),
        (F.avg("is_direct") * 100).alias("direct_pct"),
        F.count_if(F.col("rule_priority")).alias("n_priority"), *flagged)
    ent = (f.where(F.col("entity").isNotNull()).groupBy("entity")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("_t"))
           .orderBy(F.desc("_t"), "entity").limit(1)
           .select(F.col("entity").alias("top_entity"), F.col("_t").alias("top_entity_value")))
    sup = (f.where(F.col("supplier").isNotNull()).groupBy("supplier")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("_t")))
    sup_n = sup.agg(F.count(F.lit(1)).alias("n_suppliers"))
    top6 = (sup.orderBy(F.desc("_t"), "supplier").limit(n)
            .agg(F.coalesce(F.sum(F.col("_t").cast("decimal(28,2)")).cast("double"), F.lit(0.0))
                 .alias("top_suppliers_value")))
    out = attach_one_row(attach_one_row(attach_one_row(base, sup_n), top6), ent)
    has_total = F.col("total_value") != 0
    return out.select(
        "n_rows", "n_contracts", "total_value", "top_entity", "top_entity_value",
        F.when(has_total & F.col("top_entity").isNotNull(),
               _ratio(F.col("top_entity_value"), F.col("total_value")) * 100).alias("top_entity_pct"),
        "direct_pct", "n_suppliers",
        F.when(has_total & (F.col("n_suppliers") > n),
               _ratio(F.col("top_suppliers_value"), F.col("total_value")) * 100)
        .alias("top_suppliers_pct"),
        "n_priority", (F.col("n_rows") == 0).alias("is_empty"), *(["n_anomalies"] if flagged else []))


def universe_direct_share(rows: DataFrame) -> DataFrame:
    """Direct-award share over the whole snapshot (not a view)."""
    return rows.agg((F.avg("is_direct") * 100).alias("direct_pct"),
                    F.count(F.lit(1)).alias("n_rows"))


# --------------------------------------------------------------------------
# Rule-priority list
# --------------------------------------------------------------------------
def rule_list(f: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    order = [F.desc("signals"), F.desc_nulls_last("value"), F.asc("contract_id"),
             F.asc("reference")]
    top = f.where(F.col("signals") >= 2).orderBy(*order).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "risk_label", "reference", "url", "entity",
        fm.money(F.col("value")).alias("value_text"),
        fm.added_days_text(F.col("added_days")).alias("added_text"),
        "modality", "signals", "value")


# --------------------------------------------------------------------------
# Model facts: T2, A13, A14 (depend on the forest, no SQL oracle)
# --------------------------------------------------------------------------
def anomaly_list(f: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    order = [F.asc("anomaly_score"), F.asc("contract_id"), F.asc("reference")]
    top = f.where(F.col("is_anomaly")).orderBy(*order).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
        "reference", "url", F.round("anomaly_score", 3).alias("score"), "entity",
        fm.money(F.col("value")).alias("value_text"),
        F.coalesce(F.col("added_days"), F.lit(0.0)).cast("bigint").alias("added_days"),
        "modality")


def method_agreement(f: DataFrame) -> DataFrame:
    """Rows flagged by both methods, only the model, only the rules."""
    a, r = F.col("is_anomaly"), F.col("rule_priority")
    base = f.agg(F.count_if(a & r).alias("both"), F.count_if(a & ~r).alias("model_only"),
                 F.count_if(~a & r).alias("rules_only"))
    rules = F.col("both") + F.col("rules_only")
    return base.select("both", "model_only", "rules_only",
                       (F.col("both") + F.col("model_only")).alias("n_anomalies"),  # A1
                       F.when(rules > 0, F.col("both") / rules * 100).alias("overlap_pct"),
                       ((rules == 0) & (F.col("model_only") == 0)).alias("nothing_flagged"))


def anomaly_vs_rest(f: DataFrame) -> DataFrame:
    """Count, share and median value of flagged rows and of the rest."""
    counts = f.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n_rows"))
    med = percentile_exact(f, "value", 0.5, by=["is_anomaly"], out="median_value")
    tot = Window.partitionBy(F.lit(1))
    return (counts.join(med, "is_anomaly", "left")
            .withColumn("share_pct", F.col("n_rows") / F.sum("n_rows").over(tot) * 100))


# --------------------------------------------------------------------------
# One pass for many facts: GROUPING SETS over the view
# --------------------------------------------------------------------------
SET_KEYS = ("entity", "modality", "supplier", "sign_year", "value_band")
SETS = {k: [k] for k in SET_KEYS} | {"value_band": ["value_band", "value_band_label"], "all": []}
GROUP_COLUMNS = (*SET_KEYS, "value_band_label")


def _set_figures(f: DataFrame) -> list:
    return [F.sum(F.col("value").cast("decimal(18,2)")).alias("total_dec"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count("value").alias("n_values"),
            F.count_if(F.col("is_sme")).alias("n_sme"),
            F.count("is_sme").alias("n_sme_known"),
            F.sum("is_direct").alias("n_direct"),
            F.count("is_direct").alias("n_direct_known"),
            F.count_if(F.col("rule_priority")).alias("n_priority"),
            F.count_if(F.col("signals") == 3).alias("n_critical"),
            F.sum("duration_days").alias("dur_sum"),
            F.count("duration_days").alias("dur_n"), *_flag_count(f)]


def fact_sets(f: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every per-group aggregate the readings need, from one scan and one
    shuffle: grouping sets (entity) (modality) (supplier) (sign_year)
    (value_band, label) and the total, each within ``by``.  ``set`` names the
    grouping; null keys of a grouping are dropped afterwards (pandas drops
    them).  The result has one row per distinct key value.
    """
    sets = [[*by, *keys] for keys in SETS.values()]
    g = f.groupingSets(sets, *by, *GROUP_COLUMNS).agg(F.grouping_id().alias("_gid"), *_set_figures(f))
    # grouping_id bits follow the column order: entity, modality, supplier,
    # sign_year, value_band, value_band_label (1 = not grouped); those of
    # ``by`` come before and are 0.
    name = (F.when(F.col("_gid") == 0b011111, "entity").when(F.col("_gid") == 0b101111, "modality")
            .when(F.col("_gid") == 0b110111, "supplier").when(F.col("_gid") == 0b111011, "sign_year")
            .when(F.col("_gid") == 0b111100, "value_band").otherwise("all"))
    return _with_total(g.withColumn("set", name).drop("_gid"))


def _with_total(g: DataFrame) -> DataFrame:
    return g.withColumn("total_value", F.coalesce(F.col("total_dec").cast("double"), F.lit(0.0)))


def dealt_sets(f: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """``fact_sets`` of many small slices: a slice's rows go to one of ``tasks`` tasks.

    Before a shuffle the sets of small slices are hardly smaller than six
    times the rows.  Here the rows are shuffled as they are, and the sets and
    what is made of them per slice follow in the same stage (an explode keeps
    the partitions, which grouping sets do not).
    """
    kinds = dict(f.select(*GROUP_COLUMNS).dtypes)

    def group(name: str, keys: list[str]):
        return F.struct(F.lit(name).alias("set"), *[
            (F.col(c) if c in keys else F.lit(None).cast(kinds[c])).alias(c) for c in GROUP_COLUMNS])

    groups = F.array(*[group(name, keys) for name, keys in SETS.items()])
    one = f.repartition(tasks, *by).withColumn("_g", F.explode(groups)).drop(*GROUP_COLUMNS).select("*", "_g.*")
    return _with_total(one.groupBy(*by, "set", *GROUP_COLUMNS).agg(*_set_figures(f)))


def set_rows(sets: DataFrame, name: str) -> DataFrame:
    key = {"value_band": "value_band"}.get(name, name)
    out = sets.where(F.col("set") == name)
    return out if name == "all" else out.where(F.col(key).isNotNull())
