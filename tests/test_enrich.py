import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import enrich
from ledgerlens.sources.contracts import DataContractError, select_contract
from tests.fixtures import SCHEMA, contracts, buyers


@pytest.fixture(scope="module")
def universe(spark):
    return enrich.build_from_frame(contracts(spark, buyers()))


def test_thresholds_are_exposed(universe):
    th = universe.thresholds
    assert th.t_direct == pytest.approx(0.7)
    assert th.eligible_entities == 4 and th.total_entities == 5
    assert th.n_rows == 195 and th.n_inverted == 0 and th.n_no_value == 0


def test_direct_signal_only_for_the_intensive_entity(universe):
    rows = universe.rows
    flagged = {r.entity for r in rows.where("sig_direct").select("entity").distinct().collect()}
    assert flagged == {"Harbour office"}
    assert rows.where("entity = 'Chapel fund' AND sig_direct").count() == 0


def test_value_signal_is_strictly_above_p95(universe):
    t = universe.thresholds.t_value
    rows = universe.rows
    assert rows.where(F.col("sig_value") != (F.col("value") > F.lit(t))).count() == 0
    assert rows.where("sig_value").count() == 10  # ranks 185..194 of 195 lie above rank 184.3


def test_signals_risk_and_priority_agree(universe):
    bad = universe.rows.where(
        (F.col("signals") != F.col("sig_value").cast("int") + F.col("sig_direct").cast("int")
         + F.col("sig_added").cast("int"))
        | (F.col("rule_priority") != (F.col("signals") >= 2))
        | F.col("risk_label").isNull())
    assert bad.count() == 0


def test_added_days_p90_of_positive_values(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6, "added": d} for d in range(1, 101)]
    rows += [{"entity": "E", "modality": "L", "value": 1e6, "added": 0} for _ in range(50)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    assert snap.thresholds.t_added == pytest.approx(90.1)
    assert snap.rows.where("sig_added").count() == 10


def test_no_positive_added_days_turns_the_signal_off(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6 + i} for i in range(60)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    assert snap.thresholds.t_added is None
    assert snap.rows.where("sig_added").count() == 0


def test_inverted_dates_are_flagged_and_nulled(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6 + i} for i in range(59)]
    rows.append({"entity": "E", "modality": "L", "value": 5e6, "start": 10, "end": 0})
    snap = enrich.build_from_frame(contracts(spark, rows))
    assert snap.thresholds.n_inverted == 1
    bad = snap.rows.where("dates_inverted").first()
    assert bad.duration_days is None


def test_duration_floors_part_days(spark):
    df = spark.createDataFrame(
        [("E", "C1", "R1", "L", "P", True, 1.0, 0, None,
          dt.datetime(2023, 1, 2, 0), dt.datetime(2023, 1, 1, 12)),
         ("E", "C2", "R2", "L", "P", True, 1.0, 0, None,
          dt.datetime(2023, 1, 1, 0), dt.datetime(2023, 1, 2, 23))], SCHEMA)
    from ledgerlens.operators.derive import derive
    got = {r.contract_id: (r.duration_days, r.dates_inverted) for r in derive(df).collect()}
    assert got == {"C1": (None, True), "C2": (1, False)}


def test_missing_columns_are_listed_together(spark):
    df = spark.createDataFrame([("E", 1.0)], "entity string, value double")
    with pytest.raises(DataContractError) as e:
        select_contract(df)
    for name in ("contract_id", "modality", "end_at"):
        assert name in str(e.value)


def test_extra_columns_are_not_read(spark, tmp_path):
    df = contracts(spark, buyers())
    for i in range(20):
        df = df.withColumn(f"extra_{i}", F.lit(i))
    path = str(tmp_path / "wide")
    df.write.parquet(path)
    from ledgerlens.sources.contracts import load_contracts
    loaded = load_contracts(spark, path)
    assert "extra_0" not in loaded.columns
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "extra_0" not in plan


def test_url_acceptance(spark):
    from ledgerlens.functions.url import url_column
    s = spark.createDataFrame([({"url": "https://a"},), ({"url": None},), ({"url": "javascript:x"},)],
                              "process_url struct<url:string>")
    assert [r[0] for r in s.select(url_column(s)).collect()] == ["https://a", None, None]
    t = spark.createDataFrame([("http://b",), ("",), ("text",), (None,)], "process_url string")
    assert [r[0] for r in t.select(url_column(t)).collect()] == ["http://b", None, None, None]
    n = spark.createDataFrame([(3,)], "process_url int")
    assert n.select(url_column(n)).first()[0] is None


def test_numeric_coercion_rejects_spark_only_forms(spark):
    from ledgerlens.operators.derive import to_number
    df = spark.createDataFrame([("1d",), ("2.5",), ("x",), ("1e3",), (None,), (" -inf ",), ("NaN",),
                                ("1,5",)], "value string")
    got = [r[0] for r in df.select(to_number(df, "value")).collect()]
    assert got == [None, 2.5, None, 1000.0, None, float("-inf"), None, None]
