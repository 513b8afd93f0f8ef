"""Named queries over the driver's test tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame.  Contract
queries read the enriched snapshot derived from the test tables (built
once per input version, see ``plans.enrich``); text queries read
``documents`` and ``pages`` directly.  Every query covers whole tables
and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.url import url_column
from ..functions import formats as fm
from ..config import CONTAMINATION
from ..operators import iforest
from ..operators.distinct_sets import bitmaps, number_rows, sizes, united
from ..operators.ordering import with_position
from ..operators.report import attach_one_row, money_sum, short_labels, unique_short_labels
from ..operators.stats import thresholds_frame
from ..session import apply_defaults, cut, ship_package, stored, work_dir
from ..sources import manifest
from ..sources.adapter import READ_COLUMNS, contracts_from_tables
from ..sources.contracts import select_contract
from ..sources.fingerprint import fingerprint
from ..sources.text_store import search_texts
from . import enrich, facts, readings, slices, views
from .views import ViewSpec

# Parameters of the sample views used by the registered queries.
SEARCH_QUERY = "CUSTOMER#0000001 supplier#00000004"
DOC_QUERY = "Élle ouè"
DOC_TERMS = ("Apache License", "MIT License", "General Public License", "e-mail", "@", "Version 2", "http")
SAMPLE_VIEW = ViewSpec(modalities=("Contratación directa", "Licitación pública"),
                       years=(1994, 1996), bands=("90–500 M", "500 M–1 B"))
SMALL_VIEW = ViewSpec(entities=("Customer#000000007",))
EMPTY_VIEW = ViewSpec(query="no such contract")
APPEND_YEAR = 1997  # contracts signed from then on are a second batch
FLAG_BAND = 3  # stands in for the model's flag where a query is held against SQL
SAVED_VIEWS = [  # (view_id, key, value): stored parameters, some stale on purpose
    (1, "modality", "Contratación directa"), (1, "modality", "Subasta inversa"),
    (1, "from", "1990"), (1, "to", "1995"), (1, "q", "customer#00000"),
    (2, "entity", "Customer#000000007"), (2, "entity", "Nobody"), (2, "band", "> 1 B"),
    (2, "from", "1997"), (2, "to", "1993"), (2, "priority", "1"),
    (3, "band", "huge"), (3, "from", "abc"), (3, "to", "2050"),
    (4, "q", "no such contract"), (4, "modality", "Licitación pública"),
    (5, "from", "1996"), (5, "q", "SUPPLIER#00000000"), (5, "band", "< 90 M"), (5, "band", "90–500 M"),
    (6, "priority", "1"),
]


def _paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in READ_COLUMNS]


def snapshot(spark: SparkSession, sf_dir: str, salt: str = "",
             rebuild: bool = False) -> enrich.Snapshot:
    apply_defaults(spark)
    ship_package(spark)
    return enrich.get_or_build(spark, lambda: contracts_from_tables(spark, sf_dir),
                               _paths(sf_dir), salt=salt, rebuild=rebuild, columns=READ_COLUMNS)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).rows


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows without the model's columns: what SQL can follow."""
    return rows(spark, sf_dir).drop("is_anomaly", "anomaly_score")


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with a flag and score that SQL can follow in the model's place."""
    return (rule_rows(spark, sf_dir)
            .withColumn("is_anomaly", F.coalesce(F.col("value_band") == FLAG_BAND, F.lit(False)))
            .withColumn("anomaly_score", -F.col("value")))


RULE_COLUMNS = (
    "entity", "contract_id", "reference", "modality", "supplier", "is_sme", "value",
    "added_days", "signed_at", "start_at", "end_at", "duration_days", "dates_inverted",
    "is_direct", "value_band", "value_band_label", "sign_year", "search_text", "url",
    "entity_direct_rate", "entity_contracts", "sig_value", "sig_direct", "sig_added",
    "signals", "risk_label", "rule_priority")


# Nullable integer outputs are presented as double: pandas has no common
# representation for a nullable integer column across engines.
NULLABLE_INTS = ("duration_days", "sign_year", "value_band", "prev_year")


def _present(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in NULLABLE_INTS else F.col(c)
                       for c in df.columns])


def q_enriched(spark, sf):
    return _present(rows(spark, sf).select(*RULE_COLUMNS))


def q_thresholds(spark, sf):
    th = snapshot(spark, sf).thresholds_df()
    return th.select("t_value", "t_added", "t_direct", "eligible_entities", "total_entities",
                     "median_duration")


def q_thresholds_after_append(spark, sf):
    """The thresholds when the contracts of the last years come as a batch of their own.

    What the states are made of is written once: every state reads it several
    times, and the joins behind it shuffle all contracts.
    """
    from ..operators.derive import derive
    from ..operators.threshold_state import INPUT_COLUMNS, ThresholdStore
    apply_defaults(spark)
    every = stored(derive(contracts_from_tables(spark, sf)).select(*INPUT_COLUMNS, "sign_year"))
    states = ThresholdStore(spark, f"{work_dir(spark)}/ledgerlens/states/{uuid.uuid4().hex}")
    late = F.coalesce(F.col("sign_year") >= APPEND_YEAR, F.lit(False))
    states.add("before", every.where(~late))
    states.add("append", every.where(late))
    th = thresholds_frame(spark, states.thresholds(["before", "append"]))
    return th.select("t_value", "t_added", "t_direct", "eligible_entities", "total_entities",
                     "median_duration", "n_inverted", "n_no_duration", "n_no_value", "model_rows", "n_rows")


def q_quality(spark, sf):
    th = snapshot(spark, sf).thresholds_df()
    return th.select("n_no_duration", "n_inverted", "n_no_value", "model_rows", "n_rows")


def q_duplicates(spark, sf):
    return facts.duplicates(rows(spark, sf))


def q_entity_rate(spark, sf):
    snap = snapshot(spark, sf)
    return snap.entity_stats.select(
        "entity", "entity_direct_rate", "entity_contracts",
        (F.col("entity_contracts") >= 30).alias("eligible"))


def q_kpis(spark, sf):
    return facts.kpis(rule_rows(spark, sf))


def q_kpis_identified(spark, sf):
    """The KPI row with the dataset version behind it."""
    return snapshot(spark, sf).identified(facts.kpis(rule_rows(spark, sf)))


def q_kpis_view(spark, sf):
    return facts.kpis(views.apply_view(rule_rows(spark, sf), SAMPLE_VIEW))


def q_kpis_model(spark, sf):
    return facts.kpis(rows(spark, sf))


def q_kpis_flagged(spark, sf):
    return facts.kpis(flagged_rows(spark, sf))


def q_text_search(spark, sf):
    """Through the snapshot's trigram postings."""
    return snapshot(spark, sf).view(ViewSpec(query=SEARCH_QUERY)).select(
        "contract_id", "reference", "entity", "supplier", "value", "search_text")


def q_doc_search(spark, sf):
    """Through the stored normalised texts and their postings."""
    found = search_texts(spark, f"{sf}/documents.parquet", "text", ("doc_id", "lang"), DOC_QUERY)
    return found.select("doc_id", "lang", F.length("norm").cast("bigint").alias("norm_chars"))


def q_view(spark, sf):
    f = views.apply_view(rows(spark, sf), SAMPLE_VIEW)
    return _present(f.select("contract_id", "reference", "modality", "sign_year",
                             "value_band_label", "value", "signals"))


def q_saved_views(spark, sf):
    saved = spark.createDataFrame(SAVED_VIEWS, "view_id int, key string, value string")
    return views.resolve_saved_views(saved, rows(spark, sf))


def q_saved_view_facts(spark, sf):
    r = rows(spark, sf)
    saved = spark.createDataFrame(SAVED_VIEWS, "view_id int, key string, value string")
    return views.facts_by_view(r, _saved_view_table(saved, r))


def _saved_view_table(saved, r):
    return cut(views.view_table(views.resolve_saved_views(saved, r), saved))


def q_contracts_by_view(spark, sf):
    """Distinct and repeated contracts of each saved view, from bitmaps."""
    r = rows(spark, sf)
    saved = spark.createDataFrame(SAVED_VIEWS, "view_id int, key string, value string")
    return views.contracts_by_view(r, _saved_view_table(saved, r), snapshot(spark, sf).contract_numbers())


def q_contracts_since(spark, sf):
    """Distinct contracts signed in a year, and in it or any earlier one: yearly bitmaps united."""
    snap = snapshot(spark, sf)
    signed = snap.raw_rows.where("sign_year IS NOT NULL").select("sign_year", "contract_id")
    yearly = cut(bitmaps(number_rows(signed, snap.contract_numbers(), "contract_id"), ["sign_year"]))
    years = yearly.select("sign_year").distinct()  # calendar years: a short list
    upto = yearly.join(years.select(F.col("sign_year").alias("upto")), F.col("sign_year") <= F.col("upto"))
    return sizes(yearly, ["sign_year"], "n_contracts").join(
        sizes(united(upto, ["upto"]), ["upto"], "n_so_far").withColumnRenamed("upto", "sign_year"), "sign_year").select(
        F.col("sign_year").cast("bigint").alias("sign_year"), "n_contracts", "n_so_far")


def q_filter_options(spark, sf):
    return views.filter_options(rows(spark, sf))


def q_top_entities(spark, sf):
    return facts.top_entities(rows(spark, sf))


def q_modality_mix(spark, sf):
    return facts.modality_mix(rows(spark, sf))


def q_yearly(spark, sf):
    return _present(facts.yearly_value(rows(spark, sf)))


def q_median_mod(spark, sf):
    return facts.median_by_modality(rows(spark, sf))


def q_sme(spark, sf):
    return facts.sme_by_band(rows(spark, sf))


def q_pareto(spark, sf):
    return facts.supplier_pareto(rows(spark, sf))


def q_rule_list(spark, sf):
    return facts.rule_list(rows(spark, sf))


def q_risk_levels(spark, sf):
    r = rows(spark, sf)
    every = Window.partitionBy(F.lit(1))  # over the four grouped rows only
    return (r.groupBy("signals", "risk_label").agg(F.count(F.lit(1)).alias("n_rows"))
            .select("signals", "risk_label", "n_rows",
                    (F.col("n_rows") / F.sum("n_rows").over(every) * 100).alias("share_pct"),
                    (F.col("signals") >= 2).alias("rule_priority")))


def q_short_labels(spark, sf):
    r = rows(spark, sf)
    per = (r.where(F.col("entity").isNotNull()).groupBy("entity")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value")))
    top = (per.orderBy(F.desc("total_value"), "entity").limit(50)
           .withColumn("rank", F.row_number().over(
               Window.orderBy(F.desc("total_value"), "entity")).cast("bigint")))
    return unique_short_labels(top, "entity", "rank", 12).select("rank", "entity", "label")


def q_entity_labels(spark, sf):
    """Distinct short labels of all entities, in order of value."""
    r = rows(spark, sf)
    per = (r.where(F.col("entity").isNotNull()).groupBy("entity")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value")))
    ranked = with_position(per, [], [F.desc("total_value"), F.col("entity")], out="rank")
    return short_labels(ranked, "entity", "rank", 12).select("rank", "entity", "label")


def q_formatted(spark, sf):
    r = rows(spark, sf)
    total = r.agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("view_total"))
    per = (r.where(F.col("entity").isNotNull()).groupBy("entity")
           .agg(F.coalesce(money_sum("value"), F.lit(0.0)).alias("total_value"),
                F.count(F.lit(1)).alias("n_rows")))
    return attach_one_row(per, total).select(
        "entity", "total_value",
        fm.money(F.col("total_value")).alias("money_text"),
        fm.integer(F.col("n_rows")).alias("rows_text"),
        fm.percent(F.col("total_value"), F.col("view_total")).alias("pct_text"),
        fm.name_cut(F.col("entity"), 12).alias("short_name"),
        fm.share_text(F.col("total_value") / F.col("view_total") * 100).alias("share_text"),
        fm.escape_dollar(fm.money(F.col("total_value"))).alias("markdown_text"))


def q_headline(spark, sf):
    return facts.headline(rule_rows(spark, sf))


def q_headline_view(spark, sf):
    return facts.headline(views.apply_view(rule_rows(spark, sf), SAMPLE_VIEW))


def q_headline_model(spark, sf):
    return facts.headline(rows(spark, sf))


def q_headline_flagged(spark, sf):
    return facts.headline(flagged_rows(spark, sf))


def q_universe_direct(spark, sf):
    return facts.universe_direct_share(rows(spark, sf))


def q_readings(spark, sf):
    return readings.rule_readings(rule_rows(spark, sf), snapshot(spark, sf).thresholds)


def _readings_of(spec: ViewSpec):
    def run(spark, sf):
        view = views.apply_view(rule_rows(spark, sf), spec)
        return readings.rule_readings(view, snapshot(spark, sf).thresholds)
    return run


def q_readings_model(spark, sf):
    return readings.rule_readings(rows(spark, sf), snapshot(spark, sf).thresholds)


def q_readings_flagged(spark, sf):
    f = flagged_rows(spark, sf)
    return readings.rule_readings(f, snapshot(spark, sf).thresholds).unionByName(
        readings.model_readings(f))


def q_readings_by_year(spark, sf):
    """Every reading of each signing year, the flag's included."""
    f = flagged_rows(spark, sf)
    th = snapshot(spark, sf).thresholds
    return slices.readings_by(f, ["sign_year"], th).unionByName(
        slices.model_readings_by(f, ["sign_year"])).withColumn("sign_year", F.col("sign_year").cast("bigint"))


def q_readings_by_entity(spark, sf):
    return slices.readings_by(rule_rows(spark, sf), ["entity"], snapshot(spark, sf).thresholds)


def q_readings_by_view(spark, sf):
    """Every reading of each saved view, also of one that shows nothing."""
    r = rule_rows(spark, sf)
    saved = spark.createDataFrame(SAVED_VIEWS, "view_id int, key string, value string")
    return slices.readings_by_view(r, _saved_view_table(saved, r), snapshot(spark, sf).thresholds)


def q_headline_by_year(spark, sf):
    return slices.headline_by(rows(spark, sf), ["sign_year"]).withColumn(
        "sign_year", F.col("sign_year").cast("bigint"))


def q_top_suppliers_by_entity(spark, sf):
    return slices.top_by(rows(spark, sf), ["entity"], "supplier")


def q_top_entities_by_year(spark, sf):
    return slices.top_by(rows(spark, sf), ["sign_year"], "entity", label_len=38, other=False).withColumn(
        "sign_year", F.col("sign_year").cast("bigint"))


def q_term_tags(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return readings.term_tags(docs, "doc_id", "text")


def q_document_terms(spark, sf):
    """N14 with a glossary of the documents' own: terms that do occur in them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return readings.term_tags(docs, "doc_id", "text", DOC_TERMS)


def q_modality_terms(spark, sf):
    """N14 over the universe's modality texts (which do name glossary terms)."""
    mods = rows(spark, sf).where(F.col("modality").isNotNull()).select("modality").distinct()
    return readings.term_tags(mods, "modality", "modality")


def q_page_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return pages.select("page_id", url_column(pages, "url").alias("url"))


def q_export(spark, sf):
    from ..sources.export import export_frame
    return export_frame(rows(spark, sf))


def q_export_flagged(spark, sf):
    from ..sources.export import export_frame
    return export_frame(flagged_rows(spark, sf))


def q_contract_scan(spark, sf):
    """The contract check over the whole table, its optional column absent."""
    return select_contract(contracts_from_tables(spark, sf).drop("process_url"))


def q_fingerprint(spark, sf):
    return fingerprint(contracts_from_tables(spark, sf))


def q_dataset_version(spark, sf):
    """Origin, files, bytes, rows and fingerprint of what the figures are computed from."""
    return manifest.dataset_version(manifest.refresh(spark, _paths(sf), READ_COLUMNS))


def q_dataset_rows(spark, sf):
    """The part of the dataset version that SQL can follow."""
    return q_dataset_version(spark, sf).select("origin", "n_rows")


def q_stream_scoring(spark, sf):
    """The streaming scorer's transformation, run in batch over the whole
    contracts table against the published snapshot (rows-only check)."""
    from ..streaming.scorer import score_with_snapshot
    return score_with_snapshot(contracts_from_tables(spark, sf), snapshot(spark, sf))


def q_anomaly_scores(spark, sf):
    r = rows(spark, sf)
    return r.where(F.col("model_usable")).select(
        "contract_id", "reference", "value", "duration_days", "added_days", "is_direct",
        "anomaly_score", "is_anomaly")


def q_model_features(spark, sf):
    """M1-M3: the four features of every usable row, the logarithm to nine places."""
    snap = snapshot(spark, sf)
    feat = iforest.features(snap.raw_rows, snap.thresholds.median_duration).where("model_usable")
    return feat.select("contract_id", F.round("f_log_value", 9).alias("f_log_value"), "f_duration",
                       "f_added", "f_direct")


def q_model_invariants(spark, sf):
    """M4, M7, M8: what must hold of the scores, whichever forest was grown.

    The cut is the 2 % percentile of the scores, so at most ``k + 1`` rows lie
    below it and at least as many at or below it, ``k`` being the rank's floor.
    """
    r = rows(spark, sf)
    score, flag = F.col("anomaly_score"), F.col("is_anomaly")
    n = F.col("n_scored")
    k = F.floor(F.lit(CONTAMINATION) * (n - 1)) + 1
    return r.agg(
        F.count("*").alias("n_rows"), F.count_if("model_usable").alias("n_usable"),
        F.count(score).alias("n_scored"),
        F.count_if(score.isNotNull() != F.col("model_usable")).alias("n_wrongly_scored"),
        F.count_if(flag != F.coalesce(score < 0, F.lit(False))).alias("n_wrongly_flagged"),
        F.count_if(~F.col("anomaly_raw").between(-1, 0)).alias("n_out_of_range"),
        F.count_if(score < 0).alias("_below"), F.count_if(score <= 0).alias("_at")).select(
        "n_rows", "n_usable", "n_scored", "n_wrongly_scored", "n_wrongly_flagged", "n_out_of_range",
        ((F.col("_below") <= k) & (F.col("_at") >= k)).alias("cut_holds"))


def q_anomaly_list(spark, sf):
    return facts.anomaly_list(rows(spark, sf))


def q_agreement(spark, sf):
    return facts.method_agreement(rows(spark, sf))


def q_anomaly_vs_rest(spark, sf):
    return facts.anomaly_vs_rest(rows(spark, sf))


def q_flagged_list(spark, sf):
    return facts.anomaly_list(flagged_rows(spark, sf))


def q_flagged_agreement(spark, sf):
    return facts.method_agreement(flagged_rows(spark, sf))


def q_flagged_vs_rest(spark, sf):
    return facts.anomaly_vs_rest(flagged_rows(spark, sf))


def q_model_readings(spark, sf):
    return readings.model_readings(rows(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "enriched_contracts": q_enriched,
    "thresholds": q_thresholds,
    "thresholds_after_append": q_thresholds_after_append,
    "quality": q_quality,
    "duplicates": q_duplicates,
    "entity_direct_rate": q_entity_rate,
    "kpis": q_kpis,
    "text_search": q_text_search,
    "document_search": q_doc_search,
    "view_filtered": q_view,
    "saved_views": q_saved_views,
    "saved_view_facts": q_saved_view_facts,
    "contracts_by_view": q_contracts_by_view,
    "contracts_since": q_contracts_since,
    "filter_options": q_filter_options,
    "top_entities": q_top_entities,
    "modality_mix": q_modality_mix,
    "yearly_value": q_yearly,
    "median_by_modality": q_median_mod,
    "sme_by_band": q_sme,
    "supplier_pareto": q_pareto,
    "rule_list": q_rule_list,
    "risk_levels": q_risk_levels,
    "short_labels": q_short_labels,
    "entity_labels": q_entity_labels,
    "formatted_amounts": q_formatted,
    "headline_facts": q_headline,
    "universe_direct_share": q_universe_direct,
    "readings": q_readings,
    "readings_by_year": q_readings_by_year,
    "readings_by_entity": q_readings_by_entity,
    "readings_by_view": q_readings_by_view,
    "headline_by_year": q_headline_by_year,
    "top_suppliers_by_entity": q_top_suppliers_by_entity,
    "top_entities_by_year": q_top_entities_by_year,
    "term_tags": q_term_tags,
    "document_terms": q_document_terms,
    "modality_terms": q_modality_terms,
    "page_urls": q_page_urls,
    "export_rows": q_export,
    "fingerprint": q_fingerprint,
    "dataset_version": q_dataset_version,
    "dataset_rows": q_dataset_rows,
    "anomaly_scores": q_anomaly_scores,
    "stream_scoring": q_stream_scoring,
    "model_features": q_model_features,
    "model_invariants": q_model_invariants,
    "anomaly_list": q_anomaly_list,
    "method_agreement": q_agreement,
    "anomaly_vs_rest": q_anomaly_vs_rest,
    "model_readings": q_model_readings,
    "kpis_view": q_kpis_view,
    "kpis_identified": q_kpis_identified,
    "kpis_model": q_kpis_model,
    "kpis_flagged": q_kpis_flagged,
    "headline_view": q_headline_view,
    "headline_model": q_headline_model,
    "headline_flagged": q_headline_flagged,
    "readings_view": _readings_of(SAMPLE_VIEW),
    "readings_small": _readings_of(SMALL_VIEW),
    "readings_empty": _readings_of(EMPTY_VIEW),
    "readings_model": q_readings_model,
    "readings_flagged": q_readings_flagged,
    "export_flagged": q_export_flagged,
    "flagged_list": q_flagged_list,
    "flagged_agreement": q_flagged_agreement,
    "flagged_vs_rest": q_flagged_vs_rest,
    "contract_scan": q_contract_scan,
}
