"""The test-table adapter reproduces the figures recorded in FIXTURES.md §3."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def snap(spark):
    return queries.snapshot(spark, SF)


def test_universe_figures(snap):
    th = snap.thresholds
    assert th.n_rows == 6000 and th.n_no_value == 19 and th.n_inverted == 2577
    assert (th.eligible_entities, th.total_entities) == (115, 150)
    assert th.t_value == pytest.approx(1106021475.0)
    assert th.t_added == pytest.approx(45.0)
    assert th.t_direct == pytest.approx(0.89966, abs=1e-5)


def test_signal_counts(snap):
    got = {r.signals: r["count"] for r in snap.rows.groupBy("signals").count().collect()}
    assert got == {0: 4393, 1: 1467, 2: 126, 3: 14}


def test_ids_and_end_dates(snap):
    r = snap.rows.agg(F.count_distinct("contract_id").alias("ids"),
                      F.count_if(F.col("end_at").isNull()).alias("no_end")).first()
    assert (r.ids, r.no_end) == (4599, 545)
