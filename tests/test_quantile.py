import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.quantile import percentile_exact, percentile_scalars


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.75, 0.9, 0.95, 1.0])
def test_global_percentile_equals_linear_interpolation(spark, p):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = percentile_exact(df, "x", p).first()[0]
    assert got == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12, abs=1e-12)
    # a tiny local limit forces the histogram refinement path
    got2 = percentile_exact(df, "x", p, local_limit=7).first()[0]
    assert got2 == got


def test_textbook_value_and_empty_input(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    assert percentile_exact(df, "x", 0.9).first()[0] == pytest.approx(90.1)
    assert percentile_exact(df.where("x < 0"), "x", 0.9).first()[0] is None


def test_grouped_percentile_and_nulls(spark):
    rows = [("a", float(i)) for i in range(10)] + [("b", 5.0)] * 50 + [("b", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.pct for r in percentile_exact(df, "x", 0.5, by=["g"], local_limit=3).collect()}
    assert got == {"a": 4.5, "b": 5.0}


def test_scalars_share_passes(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(1000)], "x double, y double")
    got = percentile_scalars(df, {"a": (F.col("x"), 0.95), "b": (F.when(F.col("y") > 0, F.col("y")), 0.5)})
    assert got["a"] == pytest.approx(np.percentile(np.arange(1000.0), 95))
    ys = np.array([i % 7 for i in range(1000)], dtype=float)
    assert got["b"] == pytest.approx(np.percentile(ys[ys > 0], 50))


def test_observed_first_pass_is_validated(spark):
    from ledgerlens.operators.quantile import first_pass_aggs
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "x double")
    specs = {"x": (F.col("x"), 0.9)}
    first = df.agg(*first_pass_aggs(specs)).first().asDict()
    assert percentile_scalars(df, specs, first=first)["x"] == pytest.approx(90.1)
    doubled = dict(first, _n_x=first["_n_x"] * 2)  # as if a stage had been counted twice
    assert percentile_scalars(df, specs, first=doubled)["x"] == pytest.approx(90.1)
    got = percentile_scalars(df, specs, extra={"big": F.count_if(F.col("x") > 50)})
    assert got["big"] == 50


def test_narrowing_gives_the_same_as_one_pick(spark):
    import ledgerlens.operators.quantile as Q
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 40, 4000), rng.normal(0, 1, 4000))]
    rows += [(99, 1.0)] * 300 + [(99, 2.0)] * 300  # a heavy, tied group
    df = spark.createDataFrame(rows, "g int, x double")
    want = {r.g: r.pct for r in Q.percentile_exact(df, "x", 0.9, by=["g"]).collect()}
    got = {r.g: r.pct for r in Q.percentile_exact(df, "x", 0.9, by=["g"], local_limit=50).collect()}
    assert got == want and want[99] == 2.0


def test_values_of_a_large_group_are_not_shuffled(spark):
    """A group over the limit is searched where it lies: only its bracket is sorted."""
    n = 40_000
    df = spark.range(n).select((F.col("id") % 2 == 0).alias("g"), F.hash("id").cast("double").alias("x"))
    df = df.unionByName(spark.range(300).select(F.lit(None).cast("boolean").alias("g"), F.lit(1.0).alias("x")))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as beside large tables
    try:
        got = percentile_exact(df, "x", 0.5, by=["g"], local_limit=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    want = {r.g: r.m for r in df.where("g IS NOT NULL").groupBy("g").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert {r.g: r.pct for r in got.collect()} == want


def test_groups_below_and_above_the_limit(spark):
    rows = [("big", float(i)) for i in range(500)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("nan", float("nan"))]
    rows += [(f"s{k}", float(v)) for k in range(30) for v in range(k + 1)]
    df = spark.createDataFrame(rows, "g string, x double")
    for limit in (3, 40, 10_000):
        got = {r.g: r.pct for r in percentile_exact(df, "x", 0.25, by=["g"], local_limit=limit).collect()}
        want = {r.g: r.m for r in df.where("NOT isnan(x)").groupBy("g").agg(
            F.percentile("x", 0.25).alias("m")).collect()}
        assert got == pytest.approx(want), limit
