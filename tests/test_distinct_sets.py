"""Bitmaps of ids count as count(distinct) does."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import distinct_sets as D
from ledgerlens.plans import enrich, views
from tests.fixtures import contracts
from tests.test_slices import many_specs


def test_bitmaps_count_and_unite(spark):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randint(0, 90_000)}" if k % 3 else "hot", rnd.choice("abc"), rnd.randint(1, 4)) for k in range(9000)]
    rows += [(None, "a", 1)] * 20
    df = spark.createDataFrame(rows, "id string, g string, y int").repartition(5).cache()
    numbers = D.dense_numbers(df, "id").cache()
    n = df.select("id").where("id IS NOT NULL").distinct().count()
    assert sorted(r.number for r in numbers.collect()) == list(range(n))
    assert [r.id for r in numbers.orderBy("number").collect()] == sorted(r.id for r in numbers.collect())
    numbered = D.number_rows(df, numbers, "id")
    fine = D.bitmaps(numbered, ["g", "y"]).cache()
    for by in (["g"], ["y"], ["g", "y"]):
        got = {r[:-1]: r[-1] for r in D.sizes(D.united(fine, by), by).collect()}
        want = {r[:-1]: r[-1] for r in df.groupBy(*by).agg(F.count_distinct("id")).collect()}
        assert got == want
    twice = {r.g: r.n_repeated for r in D.repeated(numbered, ["g"]).collect()}
    per = df.where("id IS NOT NULL").groupBy("g", "id").count().where("count > 1").groupBy("g").count()
    assert twice == {r.g: r["count"] for r in per.collect()}
    assert D.dense_numbers(df.limit(0), "id").count() == 0


def test_contracts_of_many_views(spark):
    rnd = random.Random(9)
    rows = [{"entity": f"Office {rnd.randint(0, 6)}", "modality": rnd.choice(["Subasta", "Licitación pública"]),
             "value": rnd.choice([1e6, 2e8, 3e9]), "id": f"K{rnd.randint(0, 150)}", "ref": f"number {k % 4}",
             "signed": rnd.choice([None, 5, 400, 800])} for k in range(400)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    specs = many_specs(25, seed=8)
    saved = views.saved_rows(spark, specs)
    got = {r.view_id: r for r in views.contracts_by_view(
        snap.rows, views.view_table(saved, saved), snap.contract_numbers()).collect()}
    assert set(got) == set(specs)
    for v, spec in specs.items():
        f = views.apply_view(snap.rows, spec)
        again = f.groupBy("contract_id").count().where("count > 1").count()
        assert (got[v].n_rows, got[v].n_contracts, got[v].n_repeated) == (
            f.count(), f.select("contract_id").distinct().count(), again)
    assert snap.contract_numbers().count() == snap.rows.select("contract_id").distinct().count()
