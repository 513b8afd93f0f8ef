import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import enrich, facts, readings, views
from ledgerlens.plans.views import ViewSpec
from tests.fixtures import DIRECT, buyers, contracts


@pytest.fixture(scope="module")
def named(spark):
    rows = [{"entity": "HOSPITAL NAVAL DEL NORTE", "modality": "L", "value": 1e6, "supplier": "NEUROCLINICA S.A.S."}]
    rows += [{"entity": f"ENTIDAD {i}", "modality": "L", "value": 2e6 + i, "supplier": "SXAXSX"} for i in range(59)]
    rows[5]["entity"] = "Alcaldía de Bolívar – Corporación & Cía"
    return enrich.build_from_frame(contracts(spark, rows)).rows


def test_search_any_order_all_words(named):
    assert views.text_search(named, "naval hospital").count() == 1
    assert views.text_search(named, "hospital naval norte bogota").count() == 0
    assert views.text_search(named, "").count() == 60


def test_search_is_literal_and_accent_free(named):
    assert views.text_search(named, "s.a.s.").count() == 1
    assert views.text_search(named, "(").count() == 0
    assert views.text_search(named, "ALCALDIA bolivar CÍA").count() == 1


def test_year_filter_keeps_null_years(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6, "signed": d} for d in (0, 400, 800)]
    rows.append({"entity": "E", "modality": "L", "value": 1e6, "signed": None})
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    assert views.year_range(r).first() == (2023, 2025)
    assert views.apply_view(r, ViewSpec(years=(2024, 2025))).count() == 3


def test_year_range_without_dates(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6, "signed": None}]
    df = contracts(spark, rows)
    from ledgerlens.operators.derive import derive
    assert views.year_range(derive(df)).first() == (0, 0)


def test_stale_saved_views_are_cleaned(spark):
    r = enrich.build_from_frame(contracts(spark, buyers())).rows
    saved = spark.createDataFrame(
        [(1, "entity", "Harbour office"), (1, "entity", "GONE"), (1, "from", "1990"), (1, "to", "2050"),
         (2, "band", "nope")], "view_id int, key string, value string")
    got = sorted(tuple(x) for x in views.resolve_saved_views(saved, r).collect())
    assert (1, "entity", "Harbour office") in got and (1, "entity", "GONE") not in got
    assert all(k != "band" for _, k, _ in got)


def test_pareto_other_row_only_when_needed(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6 + i, "supplier": f"S{i % 3}"} for i in range(60)]
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    p = facts.supplier_pareto(r).collect()
    assert len(p) == 3 and not any(x.is_other for x in p)
    assert p[-1].cum_pct == pytest.approx(100.0)
    rows17 = [{"entity": "E", "modality": "L", "value": 1e6 + i, "supplier": f"S{i % 17}"} for i in range(60)]
    r17 = enrich.build_from_frame(contracts(spark, rows17)).rows
    p17 = facts.supplier_pareto(r17).collect()
    assert len(p17) == 7 and p17[-1].is_other and p17[0].n_suppliers == 17


def test_skew_clause_and_sme_bands(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6} for _ in range(60)]
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    assert facts.kpis(r).first().mean_inflated is False
    rows.append({"entity": "E", "modality": "L", "value": 1e12})
    r2 = enrich.build_from_frame(contracts(spark, rows)).rows
    assert facts.kpis(r2).first().mean_inflated is True
    bands = [{"entity": "E", "modality": "L", "value": 1e6, "sme": i < 4} for i in range(40)]
    bands += [{"entity": "E", "modality": "L", "value": 1e8, "sme": i < 36} for i in range(40)]
    s = facts.sme_by_band(enrich.build_from_frame(contracts(spark, bands)).rows)
    top = s.where("is_highest").first()
    assert top.value_band_label == "90–500 M" and top.sme_pct == pytest.approx(90.0)


def test_empty_view_readings(spark):
    r = enrich.build_from_frame(contracts(spark, buyers()))
    empty = views.apply_view(r.rows, ViewSpec(query="no such contract anywhere"))
    got = readings.rule_readings(empty, r.thresholds).collect()
    by = {x.reading: x for x in got}
    assert by["entities"].text == readings.EMPTY and by["kpis"].status == "empty"
    assert by["thresholds"].status == "normal"


def test_evolution_sign(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6, "signed": 10} for _ in range(30)]
    rows += [{"entity": "E", "modality": "L", "value": 2e6, "signed": 400} for _ in range(30)]
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    y = {x.sign_year: x for x in facts.yearly_value(r).collect()}
    assert y[2024].change_pct == pytest.approx(100.0) and y[2024].is_last


def test_term_tags(spark):
    docs = spark.createDataFrame([(1, "La mediana y la Contratación directa"), (2, "nothing")],
                                 "doc_id int, text string")
    got = sorted((r.doc_id, r.term) for r in readings.term_tags(docs, "doc_id", "text").collect())
    assert got == [(1, "Contratación directa"), (1, "Mediana")]


def test_facts_for_many_views_in_one_pass(spark):
    r = enrich.build_from_frame(contracts(spark, buyers())).rows
    specs = {1: ViewSpec(entities=("Harbour office",)), 2: ViewSpec(query="nothing matches this"),
             3: ViewSpec(modalities=("Licitación pública",))}
    saved = views.saved_rows(spark, specs)
    got = {x.view_id: x for x in views.facts_by_view(r, views.view_table(saved, saved)).collect()}
    assert got[1].n_rows == 50 and got[2].n_rows == 0 and got[2].total_value == 0.0
    assert got[3].n_rows == 89 and got[3].n_direct == 0


def test_modality_mix_keeps_five_plus_other(spark):
    rows = []
    for k, n in enumerate([30, 25, 20, 15, 10, 5, 3, 2]):
        rows += [{"entity": "E", "modality": f"M{k}", "value": 1e6} for _ in range(n)]
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    mix = {x.modality: x for x in facts.modality_mix(r).collect()}
    assert set(mix) == {"M0", "M1", "M2", "M3", "M4", "Other"}
    assert mix["Other"].n_rows == 10 and mix["Other"].is_other and mix["Other"].rank == 6
    assert mix["M0"].share_pct == pytest.approx(30 / 110 * 100)
    assert mix["M4"].slice_label == "9,1%"
    few = enrich.build_from_frame(contracts(spark, rows[:75])).rows  # M0..M2 only
    assert "Other" not in {x.modality for x in facts.modality_mix(few).collect()}


def test_rule_list_order_and_formats(spark):
    rows = [{"entity": "Harbour office", "modality": "Contratación directa", "value": v, "added": a}
            for v, a in [(5e9, 90), (2e9, 10), (3e6, 5)] + [(1e6, 0)] * 40]
    rows += [{"entity": "Water works", "modality": "Licitación pública", "value": 1e6} for _ in range(40)]
    rows += [{"entity": "School board", "modality": "Contratación directa" if i < 20 else "Licitación pública",
              "value": 1e6} for i in range(40)]
    r = enrich.build_from_frame(contracts(spark, rows)).rows
    lst = facts.rule_list(r).collect()
    assert [x.rank for x in lst] == list(range(1, len(lst) + 1))
    assert all(a.signals > b.signals or (a.signals == b.signals and (a.value or 0) >= (b.value or 0))
               for a, b in zip(lst, lst[1:]))
    top = lst[0]
    assert top.signals == 3 and top.value_text == "$5,00 mil M" and top.added_text == "+90 d"


def test_missing_threshold_keeps_the_other_sentences(spark):
    snap = enrich.build_from_frame(contracts(spark, buyers()))  # no positive added days
    assert snap.thresholds.t_added is None
    th = {r.reading: r for r in readings.rule_readings(snap.rows, snap.thresholds).collect()}["thresholds"]
    assert "high value: over" in th.text and "direct-award buyer: over 70%" in th.text
    assert "extension" not in th.text and th.status == "normal"


def test_null_signing_and_start_dates_are_tolerated(spark):
    rows = buyers()
    for r in rows[:20]:
        r["signed"] = None
        r["start"] = None
    snap = enrich.build_from_frame(contracts(spark, rows))
    r = snap.rows
    assert r.where("duration_days IS NULL").count() >= 20
    assert facts.yearly_value(r).count() >= 1
    got = readings.rule_readings(r, snap.thresholds).collect()
    assert len(got) == 10 and all(x.text for x in got)


def test_rows_meet_saved_views_without_a_shuffle(spark):
    specs = {1: ViewSpec(query="acme", years=(2023, 2023)), 2: ViewSpec(), 3: ViewSpec(entities=("A", "B")),
             4: ViewSpec(modalities=(DIRECT,), priority_only=True), 5: ViewSpec(query="nobody"), 6: ViewSpec()}
    data = [{"entity": e, "modality": m, "value": v, "supplier": s, "signed": d}
            for e in ("A", "B", None) for m in (DIRECT, None) for v in (1e6, None) for s in ("Acme", "Other")
            for d in (0, 400, None)]
    rows = enrich.build_from_frame(contracts(spark, data)).rows.select("contract_id", "search_text", *views.CELL)
    saved = views.saved_rows(spark, specs)
    table = views.view_table(saved, saved).localCheckpoint()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as beside large tables
    try:
        got = views.view_members(rows, table)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "SortMergeJoin" not in plan
    want = sorted((v, r.contract_id) for v, s in specs.items() for r in views.apply_view(rows, s).collect())
    assert sorted((r.view_id, r.contract_id) for r in got.collect()) == want
