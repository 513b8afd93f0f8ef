"""Many slices and many saved views at once, held against one view at a time."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import enrich, facts, readings, slices, views
from ledgerlens.plans.views import ViewSpec
from tests.fixtures import contracts

BUYERS = [f"Office {k}" for k in range(7)] + [None]
MODES = ["Contratación directa", "Licitación pública", "Subasta", None]


@pytest.fixture(scope="module")
def snap(spark):
    """900 contracts with nulls in every column, a buyer with a third of them, ties and repeats."""
    rnd = random.Random(5)
    rows = []
    for k in range(900):
        rows.append({
            "entity": "Office 0" if k % 3 == 0 else rnd.choice(BUYERS), "modality": rnd.choice(MODES),
            "supplier": rnd.choice([None, "Ferretería É", *[f"Supplier number {i}" for i in range(25)]]),
            "value": rnd.choice([None, 1e6, 2.5e6, 1e8, 7e8, 3e9, float(rnd.randint(1, 10**9))]),
            "id": f"K{rnd.randint(0, 600)}", "sme": rnd.choice([True, False, None]),
            "signed": rnd.choice([None, 5, 300, 400, 800, 1200]), "added": rnd.choice([None, 0, 0, 10, 400])})
    return enrich.build_from_frame(contracts(spark, rows))


@pytest.fixture(scope="module")
def rows(snap):
    return snap.rows.withColumn("is_anomaly", F.coalesce(F.col("value") > 9e8, F.lit(False))).cache()


def texts(df):
    return sorted((r.reading, r.status, r.text) for r in df.collect())


def test_readings_of_each_entity_equal_those_of_its_view(snap, rows):
    plain = rows.drop("is_anomaly", "anomaly_score")
    every = slices.readings_by(plain, ["entity"], snap.thresholds).cache()
    assert every.count() == 10 * 7  # rows without entity are in no slice
    for name in ("Office 0", "Office 3"):
        view = views.apply_view(plain, ViewSpec(entities=(name,)))
        assert texts(every.where(F.col("entity") == name)) == texts(
            readings.rule_readings(view, snap.thresholds))


def test_small_slices_are_dealt_and_large_ones_added_up_first(snap, rows, monkeypatch):
    """Office 0 has a third of the rows; where the border lies makes no difference."""
    got = []
    for most in (slices.DEALT_ROWS, 200, 0):
        monkeypatch.setattr(slices, "DEALT_ROWS", most)
        every = slices.readings_by(rows, ["entity"], snap.thresholds)
        got.append(sorted((r.entity, r.reading, r.status, r.text) for r in every.collect()))
    assert len(got[0]) == 10 * 7 and got[0] == got[1] == got[2]
    keyed, keys = slices.in_slices(rows, ["entity"])
    per = readings.set_numbers(facts.dealt_sets(keyed, keys, 5), keys)
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan  # rows move once, sets not at all


def test_flag_readings_of_each_year_and_of_two_keys(snap, rows):
    every = slices.model_readings_by(rows, ["sign_year"]).unionByName(
        slices.readings_by(rows, ["sign_year"], snap.thresholds)).cache()
    years = [r.sign_year for r in rows.select("sign_year").distinct().collect() if r.sign_year]
    assert every.count() == 12 * len(years)
    one = rows.where(F.col("sign_year") == years[0])
    assert texts(every.where(F.col("sign_year") == years[0])) == texts(
        readings.model_readings(one).unionByName(readings.rule_readings(one, snap.thresholds)))
    pairs = slices.readings_by(rows, ["entity", "sign_year"], snap.thresholds)
    both = rows.where("entity IS NOT NULL AND sign_year IS NOT NULL")
    assert pairs.count() == 10 * both.select("entity", "sign_year").distinct().count()


def test_wanted_slices_appear_without_rows(spark, snap, rows):
    wanted = spark.createDataFrame([("Office 1",), ("Nobody",)], "entity string")
    got = slices.readings_by(rows, ["entity"], snap.thresholds, wanted).collect()
    by = {(r.entity, r.reading): r for r in got}
    assert len(got) == 20 and by["Nobody", "kpis"].status == "empty"
    assert by["Nobody", "thresholds"].status == "normal" and by["Office 1", "kpis"].status == "normal"
    none = rows.where("false")
    assert slices.readings_by(none, ["entity"], snap.thresholds).count() == 0
    assert slices.top_by(none, ["entity"], "supplier").count() == 0
    flags = slices.model_readings_by(none, ["entity"], wanted).collect()
    assert {r.status for r in flags} == {"empty"} and len(flags) == 4


def test_headline_of_each_entity(rows):
    got = {r.entity: r for r in slices.headline_by(rows, ["entity"]).collect()}
    assert set(got) == {b for b in BUYERS if b}
    one = facts.headline(rows.where(F.col("entity") == "Office 0")).first()
    for name in ("n_rows", "n_contracts", "total_value", "direct_pct", "n_suppliers",
                 "top_suppliers_pct", "top_entity_pct", "n_priority"):
        assert got["Office 0"][name] == one[name]


def test_top_suppliers_of_each_entity(rows):
    got = slices.top_by(rows, ["entity"], "supplier").where("entity = 'Office 0'").orderBy("rank").collect()
    want = facts.supplier_pareto(rows.where("entity = 'Office 0'")).orderBy("rank").collect()
    assert [(r.rank, r.supplier, r.label, r.total_value, r.is_other, r.n_groups) for r in got] == [
        (r.rank, r.supplier, r.label, r.total_value, r.is_other, r.n_suppliers) for r in want]
    assert [r.cum_pct for r in got] == pytest.approx([r.cum_pct for r in want])
    assert len({r.label for r in got}) == 7  # labels cut alike are told apart


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().toString()


def test_top_lists_are_cut_before_the_shuffle(rows):
    plan = plan_of(slices.top_by(rows, ["entity"], "supplier"))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "SinglePartition" not in plan


# -- saved views as data ----------------------------------------------------

def many_specs(n, seed=3):
    rnd = random.Random(seed)
    specs = {}
    for k in range(n):
        pick = lambda xs: tuple(rnd.sample(xs, rnd.randint(1, 2))) if rnd.random() < 0.4 else ()
        years = (rnd.randint(2022, 2024), rnd.randint(2024, 2027)) if rnd.random() < 0.4 else None
        specs[k] = ViewSpec(
            query=rnd.choice(["", "", "", "office", "FERRETERÍA é", "number 1", "office  number 2", "nothing"]),
            modalities=pick([m for m in MODES if m]), entities=pick([b for b in BUYERS if b]), years=years,
            bands=pick(["< 90 M", "90–500 M", "500 M–1 B", "> 1 B"]), priority_only=rnd.random() < 0.2)
    specs[n] = ViewSpec()
    return specs


def test_members_and_facts_of_views_equal_their_filters(spark, rows):
    specs = many_specs(60)
    saved = views.saved_rows(spark, specs)
    table = views.view_table(saved, saved).cache()
    assert table.count() == len(specs)
    members = {}
    for r in views.view_members(rows, table).groupBy("view_id").agg(
            F.count("*").alias("n"), F.sum(F.hash("contract_id", "reference")).alias("h")).collect():
        members[r.view_id] = (r.n, r.h)
    got = {r.view_id: r for r in views.facts_by_view(rows, table).collect()}
    for v, spec in specs.items():
        f = views.apply_view(rows, spec)
        n, h = f.agg(F.count("*"), F.sum(F.hash("contract_id", "reference"))).first()
        assert members.get(v, (0, None)) == (n, h)
        k = facts.kpis(f).first()
        assert (got[v].n_rows, got[v].total_value, got[v].n_priority, got[v].n_critical) == (
            k.n_rows, k.total_value, k.n_priority, k.n_critical)


def test_ten_thousand_views_resolve_and_add_up(spark, rows):
    ids = spark.range(10_000).select(F.col("id").cast("int").alias("view_id"))
    office = F.concat(F.lit("Office "), (F.col("view_id") % 9).cast("string"))
    band = F.when(F.col("view_id") % 2 == 0, "> 1 B").otherwise("< 90 M")
    saved = ids.select("view_id", F.explode(F.create_map(
        F.lit("entity"), office, F.lit("band"), band, F.lit("from"), F.lit("2024"))).alias("key", "value"))
    resolved = views.resolve_saved_views(saved, rows)
    got = views.facts_by_view(rows, views.view_table(resolved, saved))
    assert got.count() == 10_000
    some = {r.view_id: r.n_rows for r in got.where("view_id IN (3, 4, 7, 8)").collect()}
    for v in (3, 4):
        spec = ViewSpec(entities=(f"Office {v}",), bands=("> 1 B" if v % 2 == 0 else "< 90 M",),
                        years=(2024, 2100))
        assert some[v] == views.apply_view(rows, spec).count()
    # of 'Office 7' and 'Office 8' nothing is left: those views show all of their band
    assert some[7] == views.apply_view(rows, ViewSpec(bands=("< 90 M",), years=(2024, 2100))).count()


def test_a_view_of_stale_choices_shows_all(spark, rows):
    saved = spark.createDataFrame([(1, "entity", "GONE")], "view_id int, key string, value string")
    table = views.view_table(views.resolve_saved_views(saved, rows), saved)
    assert views.facts_by_view(rows, table).first().n_rows == 900
    assert views.view_members(rows, table).count() == 900
