"""Readings (N1-N14): the facts of a view as plain-language sentences.

Each reading is a row ``(reading, status, text)`` built with column
expressions over one-row fact tables (attached as scalar subqueries).  ``status`` tells which variant applies (``normal``,
``empty``, ``none`` ...).  The wording is ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GLOSSARY_TERMS, MIN_MEDIAN_GROUP, TOP_N
from ..operators.quantile import percentile_exact, percentile_value
from ..functions import formats as fm
from ..operators.report import attach_one_row, first_rows
from ..operators.stats import Thresholds
from ..session import cut
from . import facts

EMPTY = "empty view."


def _one(df: DataFrame, **renames) -> DataFrame:
    return df.select(*[F.col(k).alias(v) for k, v in renames.items()])


def _left(base: DataFrame, other: DataFrame) -> DataFrame:
    """Attach a one-row (or empty) fact table as a scalar subquery."""
    return attach_one_row(base, other)


def _reading(name: str, status: Column, text: Column) -> Column:
    return F.struct(F.lit(name).alias("reading"), status.alias("status"), text.alias("text"))


def set_numbers(sets: DataFrame, by: Sequence[str] = (), lists: Sequence[Column] = ()) -> DataFrame:
    """Every single number and every first place of the readings, from one
    aggregate over the grouping sets: one row, or one for each ``by``.
    ``lists`` are further aggregates, kept under their names."""
    c = F.col
    dec = lambda col: c(col).cast("decimal(28,2)")
    has_flag = "n_anomalies" in sets.columns

    def of(name: str, *more: Column) -> Column:
        """Whether a row of ``sets`` is a group of that set (its key known)."""
        known = c("set") == name
        for cond in (*([] if name == "all" else [c(name).isNotNull()]), *more):
            known = known & cond
        return known

    def least(rows: Column, *fields: Column) -> Column:
        """Of these rows the least by the first fields, in that order."""
        return F.min(F.when(rows, F.struct(*[x.alias(f"f{k}") for k, x in enumerate(fields)])))

    share = F.try_divide(c("n_sme").cast("double"), c("n_sme_known").cast("double")) * 100
    total, band = c("total_value"), c("value_band")
    has_share = of("value_band", share.isNotNull())
    paid = of("sign_year", total > 0)
    names = ("n_rows", "total_value", "n_values", "n_priority", "n_critical",
             *(["n_anomalies"] if has_flag else []))
    x = sets.groupBy(*by).agg(
        F.max(F.when(of("all"), F.struct(
            *names, (c("n_direct") / c("n_direct_known") * 100).alias("direct_pct"),
            share.alias("sme_all"),
            F.when(c("n_values") > 0, F.try_divide(total, c("n_values").cast("double")))
            .alias("mean_value")))).alias("_all"),
        least(of("modality"), -c("n_rows"), c("modality"), c("n_rows")).alias("_m"),
        least(paid, -total, c("sign_year"), total).alias("_peak"),
        # calendar years: a short list
        F.sort_array(F.collect_list(F.when(paid, F.struct("sign_year", "total_value")))).alias("_y"),
        least(has_share, -share, band, c("value_band_label"), share).alias("_hi"),
        least(has_share, share, band, c("value_band_label")).alias("_lo"),
        F.count_if(has_share).alias("s_n"),
        F.sum(F.when(of("supplier"), dec("total_value"))).cast("double").alias("p_total"),
        F.count_if(of("supplier")).alias("n_suppliers"), *lists)
    listed = x.columns[len(x.columns) - len(lists):] if lists else []
    last, prev = F.try_element_at("_y", F.lit(-1)), F.when(
        F.size("_y") > 1, F.try_element_at("_y", F.lit(-2)))
    before = prev["total_value"]
    return x.select(
        *by, *listed, "_all.*", "s_n", "p_total", "n_suppliers", c("n_suppliers").alias("p_n"),
        c("_m.f1").alias("m1"), c("_m.f2").alias("m1_rows"),
        c("_peak.f1").alias("peak_year"), c("_peak.f2").alias("peak_value"),
        last["sign_year"].alias("last_year"), last["total_value"].alias("last_value"),
        F.size("_y").alias("n_years"),
        F.when(before != 0, (last["total_value"] - before) / before * 100).alias("change_pct"),
        c("_hi.f2").alias("s_hi"), c("_hi.f3").alias("s_hi_pct"),
        c("_lo.f2").alias("s_lo"), c("_lo.f0").alias("s_lo_pct"))


def with_shares(x: DataFrame) -> DataFrame:
    """Adds what the sentences derive from a row of numbers."""
    return (x.withColumn("mean_inflated", F.coalesce((F.col("median_value") > 0)
                                                 & (F.col("mean_value") > F.col("median_value") * 2),
                                                 F.lit(False)))
         .withColumn("top_entity", F.col("e1")).withColumn("top_entity_value", F.col("e1_value"))
         .withColumn("top_entity_pct", F.when((F.col("total_value") != 0) & F.col("e1").isNotNull(),
                                              F.col("e1_value") / F.col("total_value") * 100))
         .withColumn("top_suppliers_pct",
                     F.when((F.col("total_value") != 0) & (F.col("n_suppliers") > TOP_N),
                            F.col("top_suppliers_value") / F.col("total_value") * 100)))


def name_parts(f: DataFrame, sets: DataFrame, by: Sequence[str] = ()) -> list[DataFrame]:
    """The numbers that need more than ``set_numbers``: distinct contracts, the
    leading buyers and suppliers, and the modalities of highest and lowest
    median; one row each, or one for each ``by``."""
    c = F.col
    dec = lambda col: c(col).cast("decimal(28,2)")

    def top(name: str, n: int) -> DataFrame:
        """The ``n`` groups of a set with most value as an array ``t``."""
        groups = facts.set_rows(sets, name).select(*by, name, "total_value")
        rows = first_rows(groups, [F.desc("total_value"), c(name)], n, by)
        return rows.groupBy(*by).agg(
            F.sort_array(F.collect_list(_named_total(name))).alias("t"),
            F.sum(dec("total_value")).cast("double").alias("sum"))

    ents = top("entity", 2).select(*by, *_leading_entities(c("t")))
    sups = top("supplier", TOP_N).select(*by, *_leading_suppliers(c("t"), c("sum")))
    enough = facts.set_rows(sets, "modality").where(c("n_values") >= MIN_MEDIAN_GROUP)
    return [distinct_contracts(f, by), ents, sups, modality_medians(f, enough, by)]


def _named_total(name: str) -> Column:
    total = F.col("total_value")
    return F.struct((-total).alias("neg"), F.col(name).alias("name"), total.alias("value"))


def _leading_entities(t: Column) -> list[Column]:
    e1, e2 = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    return [e1["name"].alias("e1"), e1["value"].alias("e1_value"),
            e2["name"].alias("e2"), e2["value"].alias("e2_value")]


def _leading_suppliers(t: Column, total: Column) -> list[Column]:
    p1 = F.get(t, F.lit(0))
    return [p1["name"].alias("p1"), p1["value"].alias("p1_value"), total.alias("p_top"),
            F.coalesce(total, F.lit(0.0)).alias("top_suppliers_value")]


def distinct_contracts(f: DataFrame, by: Sequence[str]) -> DataFrame:
    return f.groupBy(*by).agg(F.count_distinct("contract_id").alias("n_contracts"))


def modality_medians(f: DataFrame, enough: DataFrame, by: Sequence[str]) -> DataFrame:
    """The modalities of highest and lowest median among those of ``enough``."""
    c = F.col
    # Medians of all modalities at once, however many there are.
    med = c("median_value")
    named = F.struct((-med).alias("neg"), "modality", med.alias("value"))
    return percentile_exact(f.where(c("modality").isNotNull()), "value", 0.5, by=[*by, "modality"],
                            out="median_value").join(
        enough.select(*by, "modality"), [*by, "modality"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("md_n"), F.min(named).alias("t"), F.max(named).alias("l")).select(
        *by, "md_n", c("t.modality").alias("md_top"), c("t.value").alias("md_top_value"),
        c("l.modality").alias("md_low"), c("l.value").alias("md_low_value"))


def dealt_numbers(f: DataFrame, by: Sequence[str], tasks: int) -> tuple[DataFrame, list[DataFrame]]:
    """``set_numbers`` and ``name_parts`` of many small slices (``facts.dealt_sets``).

    The leading buyers and suppliers come from lists that hold all names of a
    slice, so slices must be small.
    """
    def first(name: str, n: int) -> Column:
        group = (F.col("set") == name) & F.col(name).isNotNull()
        return F.slice(F.sort_array(F.collect_list(F.when(group, _named_total(name)))), 1, n)

    x = set_numbers(facts.dealt_sets(f, by, tasks), by, [
        first("entity", 2).alias("_ents"), first("supplier", TOP_N).alias("_sups")])
    held = F.aggregate("_sups", F.lit(0).cast("decimal(38,2)"), lambda total, s: (
        total + s["value"].cast("decimal(28,2)")).cast("decimal(38,2)")).cast("double")
    x = x.select("*", *_leading_entities(F.col("_ents")), *_leading_suppliers(
        F.col("_sups"), F.when(F.size("_sups") > 0, held))).drop("_ents", "_sups")
    enough = f.where(F.col("modality").isNotNull()).groupBy(*by, "modality").agg(
        F.count("value").alias("n_values")).where(F.col("n_values") >= MIN_MEDIAN_GROUP)
    return x, [distinct_contracts(f.select(*by, "contract_id").repartition(tasks, *by), by),
               modality_medians(f, enough, by)]


def rule_readings(f: DataFrame, th: Thresholds) -> DataFrame:
    """N1-N10 and N13 for the view ``f`` (thresholds come from the universe).

    The headline names the anomalous rows where ``f`` has the model's flag.

    All group-level numbers come from one grouping-sets pass over the view
    (``facts.fact_sets``, written once: it has one row per distinct key);
    medians and the distinct-id count are the only other passes.
    """
    spark = f.sparkSession
    sets = cut(facts.fact_sets(f))
    median = percentile_value(f, "value", 0.5)
    x = set_numbers(sets)
    for part in name_parts(f, sets):
        x = _left(x, part)
    # One row of single numbers: the sentences are made from its values, so
    # their long expressions don't drag the aggregates' plans along.
    x = spark.createDataFrame(x.collect(), x.schema)
    x = x.withColumn("median_value", F.lit(median).cast("double"))
    return sentences(with_shares(x), th)


def sentences(x: DataFrame, th: Thresholds, by: Sequence[str] = ()) -> DataFrame:
    """N1-N10 and N13 of each row of numbers (``set_numbers``, ``with_shares`` and the tops)."""
    c = F.col
    has_flag = "n_anomalies" in x.columns
    empty = F.coalesce(F.col("n_rows"), F.lit(0)) == 0

    def guard(status: Column, text: Column, name: str) -> Column:
        return _reading(name, F.when(empty, F.lit("empty")).otherwise(status),
                        F.when(empty, F.lit(EMPTY)).otherwise(text))

    headline = F.concat_ws(
        " ",
        F.concat(F.lit("contracts: "), fm.integer(c("n_contracts")),
                 F.lit("; value: "), fm.money(c("total_value")), F.lit(";")),
        F.when(c("top_entity_pct").isNotNull(),
               F.concat(F.lit("top buyer: "), fm.name_cut(c("top_entity")),
                        F.lit(" = "), fm.percent(c("top_entity_value"), c("total_value")),
                        F.lit(" of value;"))),
        F.when(c("direct_pct").isNotNull(),
               F.concat(fm.whole_percent(c("direct_pct")),
                        F.lit(" direct awards;"))),
        F.when(c("top_suppliers_pct").isNotNull(),
               F.concat(F.lit("suppliers: "), fm.integer(c("n_suppliers")), F.lit("; largest "),
                        F.lit(str(TOP_N)), F.lit(" hold "),
                        fm.percent(c("top_suppliers_value"), c("total_value")),
                        F.lit(" of value;"))),
        F.concat(fm.integer(c("n_priority")), F.lit(" priority contracts"),
                 *([F.lit("; "), fm.integer(c("n_anomalies")), F.lit(" anomalies")]
                   if has_flag else [])))

    kpi_text = F.concat(
        F.lit("mean value: "), fm.money(c("mean_value")),
        F.lit("; median value: "), fm.money(c("median_value")), F.lit("."),
        F.when(c("mean_inflated"), F.lit(" Mean far above median."))
        .otherwise(F.lit("")))

    ent_ok = c("e1").isNotNull() & (c("total_value") != 0)
    ent_text = F.concat(
        fm.name_cut(c("e1")), F.lit(": "), fm.money(c("e1_value")), F.lit(", "),
        fm.percent(c("e1_value"), c("total_value")), F.lit(" of value."),
        F.when(c("e2").isNotNull(), F.concat(F.lit(" 2nd: "), fm.name_cut(c("e2")),
                                             F.lit(" at "), fm.percent(c("e2_value"), c("total_value")),
                                             F.lit("."))).otherwise(F.lit("")))

    mod_text = F.concat(
        F.lit("main modality: "), fm.name_cut(c("m1"), 45), F.lit(" ("),
        fm.percent(c("m1_rows"), c("n_rows")), F.lit(" of rows); direct awards: "),
        fm.whole_percent(c("direct_pct")), F.lit("."))

    change_ok = (c("n_years") >= 2) & c("change_pct").isNotNull()
    evo_text = F.concat(
        F.lit("peak year: "), c("peak_year").cast("string"), F.lit(" = "),
        fm.money(c("peak_value")), F.lit("."),
        F.when(change_ok, F.concat(
            F.lit(" Latest "), c("last_year").cast("string"), F.lit(": "),
            fm.money(c("last_value")), F.lit(", "),
            F.regexp_replace(F.format_number(F.abs(c("change_pct")), 0), ",", ""), F.lit("% "),
            F.when(c("change_pct") >= 0, F.lit("up")).otherwise(F.lit("down")),
            F.lit(" on the previous year."))).otherwise(F.lit("")))

    med_text = F.when(c("md_n") == 0, F.lit(
        f"medians: no modality with {MIN_MEDIAN_GROUP} rows"
    )).otherwise(F.concat(
        F.lit("highest median: "), fm.name_cut(c("md_top"), 45),
        F.lit(" at "), fm.money(c("md_top_value")), F.lit("."),
        F.when(c("md_n") > 1, F.concat(
            F.lit(" Lowest median: "), fm.name_cut(c("md_low"), 45),
            F.lit(" at "), fm.money(c("md_low_value")), F.lit(".")))
        .otherwise(F.lit(""))))

    sme_text = F.concat(
        F.lit("SME share: "), fm.whole_percent(c("sme_all")), F.lit("."),
        F.when(c("s_n") >= 2, F.concat(
            F.lit(" Highest band: "), c("s_hi"), F.lit(" ("),
            fm.whole_percent(c("s_hi_pct")), F.lit("), lowest: "), c("s_lo"), F.lit(" ("),
            fm.whole_percent(c("s_lo_pct")), F.lit(")."))).otherwise(F.lit("")))

    par_ok = c("p1").isNotNull() & (c("p_total") != 0)
    par_text = F.concat(
        fm.integer(c("p_n")), F.lit(" suppliers; top "), F.lit(str(TOP_N)),
        F.lit(": "), fm.percent(c("p_top"), c("p_total")),
        F.lit(" of value; first: "), fm.name_cut(c("p1"), 45),
        F.lit(", "), fm.percent(c("p1_value"), c("p_total")), F.lit("."))

    thr_parts = []
    if th.t_value is not None:
        thr_parts.append(F.concat(F.lit("high value: over "),
                                  fm.money(F.lit(th.t_value)), F.lit(".")))
    if th.t_added is not None:
        thr_parts.append(F.concat(F.lit("long extension: over "),
                                  fm.integer(F.lit(th.t_added)), F.lit(" days.")))
    if th.t_direct is not None:
        thr_parts.append(F.concat(F.lit("direct-award buyer: over "),
                                  fm.whole_percent(F.lit(th.t_direct * 100)),
                                  F.lit(" direct.")))
    thr_text = (F.concat_ws(" ", *thr_parts) if thr_parts
                else F.lit("thresholds: none."))

    rules_text = F.when(c("n_priority") == 0, F.lit(
        "priority: none.")).otherwise(F.concat(
            fm.integer(c("n_priority")), F.lit(" priority rows ("),
            fm.percent(c("n_priority"), c("n_rows")), F.lit(" of rows), "),
            fm.integer(c("n_critical")), F.lit(" with three signals.")))

    items = [
        guard(F.lit("normal"), headline, "headline"),
        guard(F.lit("normal"), kpi_text, "kpis"),
        guard(F.when(ent_ok, F.lit("normal")).otherwise(F.lit("empty")),
              F.when(ent_ok, ent_text).otherwise(F.lit(EMPTY)), "entities"),
        guard(F.when(c("m1").isNotNull(), F.lit("normal")).otherwise(F.lit("empty")),
              F.when(c("m1").isNotNull(), mod_text).otherwise(F.lit(EMPTY)), "modalities"),
        guard(F.when(c("peak_year").isNotNull(), F.lit("normal")).otherwise(F.lit("empty")),
              F.when(c("peak_year").isNotNull(), evo_text).otherwise(F.lit(EMPTY)), "evolution"),
        guard(F.when(c("md_n") == 0, F.lit("none")).otherwise(F.lit("normal")), med_text,
              "median_by_modality"),
        guard(F.when(c("s_n") > 0, F.lit("normal")).otherwise(F.lit("empty")),
              F.when(c("s_n") > 0, sme_text).otherwise(F.lit(EMPTY)), "sme"),
        guard(F.when(par_ok, F.lit("normal")).otherwise(F.lit("empty")),
              F.when(par_ok, par_text).otherwise(F.lit(EMPTY)), "suppliers"),
        _reading("thresholds", F.lit("normal" if thr_parts else "none"), thr_text),
        guard(F.when(c("n_priority") == 0, F.lit("zero")).otherwise(F.lit("normal")), rules_text,
              "rules"),
    ]
    return x.select(*by, F.explode(F.array(*items)).alias("r")).select(*by, "r.*")


def model_readings(f: DataFrame) -> DataFrame:
    """What the flag ``is_anomaly`` of the view says, beside the rules."""
    spark = f.sparkSession
    ag = facts.method_agreement(f)
    base = f.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anomaly").alias("n_anom"))
    vs = facts.anomaly_vs_rest(f)
    ma = _one(vs.where("is_anomaly"), median_value="med_anom")
    mr = _one(vs.where("NOT is_anomaly"), median_value="med_rest")
    return flag_sentences(_left(_left(_left(_left(spark.range(1), base), ag), ma), mr))


def flag_sentences(x: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N11-N12 of each row of numbers about the flag."""
    c = F.col
    empty = c("n_rows") == 0
    anom = F.when(c("n_anom") == 0, F.lit("anomalies: none.")) \
        .otherwise(F.concat(
            F.lit("anomalies: "), fm.integer(c("n_anom")), F.lit(" ("),
            fm.percent(c("n_anom"), c("n_rows")), F.lit(" of rows); median value: "),
            fm.money(c("med_anom")), F.lit(" vs "), fm.money(c("med_rest")),
            F.lit(" elsewhere.")))
    agree = F.when(c("nothing_flagged"), F.lit("agreement: nothing flagged.")) \
        .otherwise(F.concat(
            fm.integer(c("both")), F.lit(" by both, "),
            fm.integer(c("model_only")), F.lit(" model only, "),
            fm.integer(c("rules_only")), F.lit(" rules only."),
            F.when(c("overlap_pct").isNotNull(), F.concat(
                F.lit(" Overlap: "), fm.percent(c("both"), c("both") + c("rules_only")),
                F.lit(" of priority rows.")))
            .otherwise(F.lit(""))))
    items = [
        _reading("anomalies", F.when(empty, F.lit("empty")).when(c("n_anom") == 0, F.lit("zero"))
                 .otherwise(F.lit("normal")), F.when(empty, F.lit(EMPTY)).otherwise(anom)),
        _reading("agreement", F.when(empty, F.lit("empty")).when(c("nothing_flagged"), F.lit("none"))
                 .otherwise(F.lit("normal")), F.when(empty, F.lit(EMPTY)).otherwise(agree)),
    ]
    return x.select(*by, F.explode(F.array(*items)).alias("r")).select(*by, "r.*")


def term_tags(texts: DataFrame, id_col: str, text_col: str,
              terms: Sequence[str] = GLOSSARY_TERMS) -> DataFrame:
    """Which terms occur (case-insensitively) in each text.

    The terms are a constant array; each whole text is lower-cased once and
    matched against it within its row, without a join.
    """
    listed = F.array(*[F.lit(t) for t in terms])
    found = F.transform(F.array(F.lower(F.col(text_col))), lambda low: F.filter(
        listed, lambda t: F.contains(low, F.lower(t))))
    return texts.select(id_col, F.explode(found[0]).alias("term"))
