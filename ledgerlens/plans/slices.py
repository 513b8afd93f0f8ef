"""Facts and readings of many slices at once.

A slice is any set of rows that share a key: a year, an entity, or a saved
view after ``views.view_members`` has tagged its rows.  All slices go through
one plan: grouping sets with the key, percentiles and top lists per key.
Nothing loops over slices or collects them, so their number may grow with
the data.  Partial aggregates come before every shuffle, and top lists cut
each task's rows first, so a slice that holds most rows costs no more than
many small ones.

Thresholds belong to the universe and are the same for all slices.  Rows
whose key is null are in no slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOP_N
from ..functions import formats as fm
from ..operators.quantile import percentile_exact
from ..operators.report import OTHER, cumulative, first_rows, money_sum, unique_short_labels
from ..operators.stats import Thresholds
from ..session import cut, stored
from . import facts
from .readings import (dealt_numbers, flag_sentences, name_parts, sentences, set_numbers,
                       with_shares)
from .views import view_members

DEALT_ROWS = 4096  # of a slice whose rows are brought together
ROWS_A_TASK = 200_000


def in_slices(rows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows that lie in a slice, and the names of their key columns.

    Keys are copies of the columns ``by``, which the facts may group by as well.
    """
    keys = [f"_by_{name}" for name in by]
    for key, name in zip(keys, by, strict=True):
        rows = rows.withColumn(key, F.col(name)).where(F.col(key).isNotNull())
    return rows, keys


def _named(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({f"_by_{name}": name for name in by})


def _all_wanted(x: DataFrame, by: Sequence[str], keys: list[str], wanted: DataFrame | None) -> DataFrame:
    if wanted is None:
        return x
    return in_slices(wanted, by)[0].select(*keys).distinct().join(x, keys, "left")


def _numbers(rows: DataFrame, by: Sequence[str], wanted: DataFrame | None) -> DataFrame:
    """One row of numbers for each slice: all that its sentences need.

    Slices of up to ``DEALT_ROWS`` rows are brought together and counted in
    one task each; larger ones, of which there are at most a
    ``DEALT_ROWS``th of the rows, are first added up where their rows lie.
    """
    rows, keys = in_slices(rows, by)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    few = F.col("_n") <= DEALT_ROWS
    n, n_large = size.agg(F.sum(F.when(few, F.col("_n"))), F.count_if(~few)).first()
    found = []
    if n_large or not n:
        some = rows
        if n:
            large = cut(size.where(~few).select(*keys))
            some = rows.join(F.broadcast(large), keys, "left_semi")
        sets = cut(facts.fact_sets(some, keys))
        found.append(_joined(set_numbers(sets, keys), name_parts(some, sets, keys), keys))
    if n:
        some = rows.join(F.broadcast(large), keys, "left_anti") if n_large else rows
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS_A_TASK)
        found.append(_joined(*dealt_numbers(some, keys, tasks), keys))
    x = _all_wanted(reduce(DataFrame.unionByName, found), by, keys, wanted)
    x = x.join(percentile_exact(rows, "value", 0.5, by=keys, out="median_value"), keys, "left")
    counts = [c for c in x.columns if c in ("n_rows", "n_values", "n_priority", "n_critical",
                                            "n_anomalies", "n_contracts", "n_suppliers", "md_n")]
    return with_shares(x.fillna(0, counts))


def _joined(x: DataFrame, parts: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    for part in parts:
        x = x.join(part, keys, "left")
    return x


def readings_by(rows: DataFrame, by: Sequence[str], th: Thresholds,
                wanted: DataFrame | None = None) -> DataFrame:
    """N1-N10 and N13 of every slice: ``(*by, reading, status, text)``.

    ``wanted`` lists the slices that must appear, also without rows; by
    default those that have rows.  The numbers are written once, so the
    sentences' long expressions don't drag the aggregates along.
    """
    keys = [f"_by_{name}" for name in by]
    return _named(sentences(cut(_numbers(rows, by, wanted)), th, keys), by)


#: What the numbers of the readings are made of.
READING_COLUMNS = ("contract_id", "entity", "modality", "supplier", "sign_year", "value_band",
                   "value_band_label", "value", "is_sme", "is_direct", "rule_priority", "signals",
                   "duration_days")


def readings_by_view(rows: DataFrame, views: DataFrame, th: Thresholds) -> DataFrame:
    """N1-N10 and N13 of every saved view of a ``view_table``, also of one that shows nothing.

    The views' rows are tagged once and written with the columns that the
    numbers need, as several passes read them.
    """
    flags = [c for c in ("is_anomaly",) if c in rows.columns]
    tagged = view_members(rows.select(*READING_COLUMNS, "search_text", *flags), views)
    return readings_by(stored(tagged.drop("search_text")), ["view_id"], th, wanted=views)


def model_readings_by(rows: DataFrame, by: Sequence[str],
                      wanted: DataFrame | None = None) -> DataFrame:
    """N11-N12 of every slice of rows that carry the flag ``is_anomaly``."""
    rows, keys = in_slices(rows, by)
    a, r = F.col("is_anomaly"), F.col("rule_priority")
    x = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(a).alias("n_anom"),
        F.count_if(a & r).alias("both"), F.count_if(a & ~r).alias("model_only"),
        F.count_if(~a & r).alias("rules_only"))
    med = percentile_exact(rows, "value", 0.5, by=[*keys, "is_anomaly"], out="_med").groupBy(*keys).agg(
        F.max(F.when(a, F.col("_med"))).alias("med_anom"),
        F.max(F.when(~a, F.col("_med"))).alias("med_rest"))
    rules = F.col("both") + F.col("rules_only")
    x = (_all_wanted(x, by, keys, wanted).join(med, keys, "left")
         .fillna(0, ["n_rows", "n_anom", "both", "model_only", "rules_only"])
         .withColumn("overlap_pct", F.when(rules > 0, F.col("both") / rules * 100))
         .withColumn("nothing_flagged", (rules == 0) & (F.col("model_only") == 0)))
    return _named(flag_sentences(x, keys), by)


def headline_by(rows: DataFrame, by: Sequence[str], n: int = TOP_N) -> DataFrame:
    """A17 of every slice: its headline numbers, null where a clause does not apply."""
    rows, keys = in_slices(rows, by)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("contract_id").alias("n_contracts"),
        F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value"),
        (F.avg("is_direct") * 100).alias("direct_pct"),
        F.count_if(F.col("rule_priority")).alias("n_priority"))
    ent = _totals(rows, keys, "entity")
    first = ent.groupBy(*keys).agg(F.min(F.struct(
        (-F.col("total_value")).alias("neg"), "entity", "total_value")).alias("_e")).select(
        *keys, F.col("_e.entity").alias("top_entity"), F.col("_e.total_value").alias("top_entity_value"))
    sup = _totals(rows, keys, "supplier")
    n_sup = sup.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_suppliers"))
    top = first_rows(sup, [F.desc("total_value"), F.col("supplier")], n, keys).groupBy(*keys).agg(
        F.sum(F.col("total_value").cast("decimal(28,2)")).cast("double").alias("_top"))
    x = base
    for part in (first, n_sup, top):
        x = x.join(part, keys, "left")
    has_total = F.col("total_value") != 0
    return _named(x.fillna(0, ["n_suppliers"]).select(
        *keys, "n_rows", "n_contracts", "total_value", "top_entity", "top_entity_value",
        F.when(has_total, F.col("top_entity_value") / F.col("total_value") * 100).alias("top_entity_pct"),
        "direct_pct", "n_suppliers",
        F.when(has_total & (F.col("n_suppliers") > n), F.col("_top") / F.col("total_value") * 100)
        .alias("top_suppliers_pct"), "n_priority"), by)


def _totals(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(
        F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value"))


def top_by(rows: DataFrame, by: Sequence[str], key: str, n: int = TOP_N, label_len: int = 18,
           other: bool = True) -> DataFrame:
    """A7 / A12 of every slice: its ``n`` groups of ``key`` with most value, ranked,
    and where more exist one row for all others (T4, U1), with labels that are
    distinct in the slice (W3), shares of the slice and their running sum (W1).
    """
    rows, keys = in_slices(rows, by)
    per = _totals(rows, keys, key)
    money = F.col("total_value").cast("decimal(28,2)")
    every = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(money).alias("_all"))
    top = first_rows(per, [F.desc("total_value"), F.col(key)], n, keys, rank="rank")
    out = top.select(*keys, "rank", key, "total_value", F.lit(False).alias("is_other"))
    if other:
        listed = top.groupBy(*keys).agg(F.sum(money).alias("_top"))
        rest = every.where(F.col("n_groups") > n).join(listed, keys).select(
            *keys, F.lit(n + 1).cast("bigint").alias("rank"), F.lit(OTHER).alias(key),
            (F.col("_all") - F.col("_top")).cast("double").alias("total_value"),
            F.lit(True).alias("is_other"))
        out = out.unionByName(rest)
    out = unique_short_labels(out, key, "rank", label_len, by=keys).join(every, keys)
    all_value = F.col("_all").cast("double")
    out = out.withColumn("pct", F.when(all_value != 0, F.col("total_value") / all_value * 100))
    # At most n + 1 rows of each slice.
    return _named(out.select(*keys, "rank", key, "label", "total_value", "pct",
                      cumulative("pct", by=keys).alias("cum_pct"),
                      fm.percent(F.col("total_value"), all_value).alias("share_text"),
                      "n_groups", "is_other"), by)
