import numpy as np
import pytest

from ledgerlens.plans import enrich
from tests.fixtures import contracts


def test_model_flags_about_the_contamination_share(spark):
    rows = [{"entity": "E", "modality": "Licitación", "value": 1e6 + i, "end": 100 + i} for i in range(1000)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    r = snap.rows
    share = r.where("is_anomaly").count() / r.count()
    assert share == pytest.approx(0.02, abs=0.01)
    assert r.where("is_anomaly AND anomaly_score IS NULL").count() == 0


def test_model_is_repeatable_and_partition_independent(spark):
    rows = [{"entity": "E", "modality": "L", "value": float(v), "end": 100 + (i * 37) % 900}
            for i, v in enumerate(np.geomspace(1e6, 1e10, 400))]
    df = contracts(spark, rows)
    a = enrich.build_from_frame(df.coalesce(1)).rows
    b = enrich.build_from_frame(df.repartition(7)).rows
    fa = {r.contract_id: (r.is_anomaly, round(r.anomaly_score, 12)) for r in a.collect()}
    fb = {r.contract_id: (r.is_anomaly, round(r.anomaly_score, 12)) for r in b.collect()}
    assert fa == fb


def test_model_is_skipped_for_few_rows(spark):
    rows = [{"entity": "E", "modality": "L", "value": 1e6} for _ in range(10)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    assert snap.rows.where("is_anomaly").count() == 0
    assert snap.rows.where("anomaly_score IS NOT NULL").count() == 0


def test_cheap_but_long_contracts_are_found(spark):
    vals = np.geomspace(1e6, 1e12, 200)
    rows = [{"entity": "E", "modality": "L", "value": float(v), "end": 100} for v in vals]
    for i in (5, 6):
        rows[i]["end"] = 5000
    snap = enrich.build_from_frame(contracts(spark, rows))
    flagged = {r.contract_id for r in snap.rows.where("is_anomaly").collect()}
    assert {"K5", "K6"} <= flagged
    med = float(np.median(vals))
    cheap = {f"K{i}" for i, v in enumerate(vals) if v < med}
    assert flagged & cheap


def test_heavy_copy_group_is_sampled_in_chunks(spark):
    """100,000 identical rows (more than one chunk of copies) among 300,000:
    the pool draws copies chunk by chunk with per-copy trials, the result
    does not depend on partitioning, and identical rows score identically."""
    from pyspark.sql import functions as F
    from ledgerlens.operators import iforest as I

    n = 300_000
    base = spark.range(n).select(
        F.when(F.col("id") < 100_000, F.lit(5e6)).otherwise(F.col("id") * 1000.0 + 1e6).alias("f_log_value"),
        F.when(F.col("id") < 100_000, F.lit(100.0)).otherwise((F.col("id") % 500).cast("double")).alias("f_duration"),
        F.lit(0.0).alias("f_added"), F.lit(1.0).alias("f_direct"))
    pools = []
    for parts in (1, 5):
        pool = I.sample_pool(base.repartition(parts), n, 200, 256, 42)
        pools.append(sorted(tuple(r) for r in pool.select("_key", "f_log_value").collect()))
    assert pools[0] == pools[1]
    heavy = sum(1 for k, v in pools[0] if v == 5e6)
    q = 204_800 / n
    assert abs(heavy - 100_000 * q) < 5 * (100_000 * q * (1 - q)) ** 0.5
    forest = I.fit(base, n, 200, 256, 42)
    x = np.array([[5e6, 100.0, 0.0, 1.0], [5e6, 100.0, 0.0, 1.0], [9e7, 3.0, 0.0, 1.0]])
    s = forest.raw_score(x)
    assert s[0] == s[1] and s[2] < s[0]


def test_scores_equal_a_recursive_walk_over_the_node_table(spark):
    """The published forest as a table: DuckDB walks every row down every tree."""
    import duckdb
    from ledgerlens.operators import iforest as I

    rows = [{"entity": "E", "modality": "Contratación directa" if i % 3 else "L", "value": float(v),
             "end": 100 + (i * 37) % 900, "added": i % 7 * 30}
            for i, v in enumerate(np.geomspace(1e6, 1e10, 120))]
    snap = enrich.build_from_frame(contracts(spark, rows))
    feat = I.features(snap.rows, snap.thresholds.median_duration).where("model_usable").select(
        "contract_id", *I.FEATURES, "anomaly_raw")
    con = duckdb.connect()
    con.register("points", feat.toPandas())
    con.register("nodes", spark.read.parquet(f"{snap.path}/forest").toPandas())
    got = con.execute("""
      WITH RECURSIVE walk AS (
        SELECT contract_id, [f_log_value, f_duration, f_added, f_direct] AS x, anomaly_raw, _tree, 0 AS node
        FROM points, (SELECT DISTINCT _tree FROM nodes)
        UNION ALL
        SELECT w.contract_id, w.x, w.anomaly_raw, w._tree,
               CASE WHEN w.x[n.feature + 1] > n.threshold THEN n."right" ELSE n."left" END
        FROM walk w JOIN nodes n USING (_tree, node) WHERE n.feature >= 0),
      ends AS (SELECT w.contract_id, w.anomaly_raw, n.leaf_path, n.max_samples
               FROM walk w JOIN nodes n USING (_tree, node) WHERE n.feature < 0)
      SELECT contract_id, any_value(anomaly_raw) AS ours, avg(leaf_path) AS mean_path,
             count(*) AS trees, any_value(max_samples) AS m FROM ends GROUP BY contract_id""").df()
    assert len(got) == 120 and (got["trees"] == 200).all()
    want = -np.power(2.0, -got["mean_path"] / I.c_factor([int(got["m"].iloc[0])])[0])
    assert np.abs(want - got["ours"]).max() < 1e-12


def test_scores_do_not_depend_on_batches():
    from ledgerlens.operators import iforest as I
    rng = np.random.default_rng(3)
    import pandas as pd
    nodes = []
    for t in range(20):
        sample = pd.DataFrame({f: rng.normal(size=64) for f in I.FEATURES})
        nodes.append(I._grow_one(sample.assign(_tree=t, _u=0, _key=range(64)), 1, 6))
    forest = I.forest_from_nodes(pd.concat(nodes), 20, 64, 6)
    x = rng.normal(size=(10_000, 4))
    whole = forest.raw_score(x)
    parts = np.concatenate([forest.raw_score(x[k:k + 7]) for k in range(0, 700, 7)])
    assert (whole[:700] == parts).all() and len(forest.raw_score(x[:0])) == 0


def _grown(n_trees, size, depth):
    import pandas as pd
    from ledgerlens.operators import iforest as I
    rng = np.random.default_rng(5)
    nodes = []
    for t in range(n_trees):
        sample = pd.DataFrame({f: rng.normal(size=size).round(1) for f in I.FEATURES})
        sample["f_direct"] = rng.integers(0, 2, size)
        nodes.append(I._grow_one(sample.assign(_tree=t, _u=0, _key=range(size)), 1, depth))
    return I.forest_from_nodes(pd.concat(nodes), n_trees, size, depth)


def _walked(forest, x):
    """Mean path length of each row, down every tree node by node."""
    total = np.zeros(len(x))
    for t in range(len(forest.feature)):
        for i, row in enumerate(x):
            o = 0
            while forest.feature[t, o] >= 0:
                o = (forest.right if row[forest.feature[t, o]] > forest.threshold[t, o] else forest.left)[t, o]
            total[i] += forest.leaf_path[t, o]
    return total / len(forest.feature)


@pytest.mark.parametrize("cells", [1 << 18, 40])
def test_tables_of_trees_give_the_walked_lengths(monkeypatch, cells):
    """Also on thresholds themselves, beyond them and without a number, and where a
    tree is cut into several tables; a row takes a look-up for each feature, not for
    each level."""
    from ledgerlens.operators import iforest as I
    monkeypatch.setattr(I, "_CELLS", cells)
    forest = _grown(12, 64, 6)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    x[:40, 0] = forest.threshold[forest.feature == 0][:40]
    x[40:50], x[50:60], x[60:70, 1] = np.inf, -np.inf, np.nan
    assert (forest.path_lengths(x) == _walked(forest, x)).all()
    tables = forest._tables()
    assert (len(tables) == 12) == (cells > 40) and all(grid.size <= max(cells, 7 ** 4) for _, grid, _ in tables)


def test_a_forest_of_leaves_is_scored():
    forest = _grown(3, 1, 1)
    assert (forest.path_lengths(np.zeros((5, 4))) == 0).all()


def test_rows_are_scored_and_labelled_after_their_last_shuffle(spark, monkeypatch):
    """The shuffle by year carries no column that is made of others, one Python stage follows."""
    from ledgerlens.sources import snapshot as store
    plans, write = [], store.write_parquet

    def seen(df, path, *args, **kwargs):
        plans.append((path.rsplit("/", 1)[-1], df._jdf.queryExecution().executedPlan().toString(),
                      df.columns, kwargs))
        return write(df, path, *args, **kwargs)
    monkeypatch.setattr(store, "write_parquet", seen)
    rows = [{"entity": "E", "modality": "L", "value": 1e6 * (i + 1), "end": 100 + i} for i in range(100)]
    snap = enrich.build_from_frame(contracts(spark, rows))
    by = {name: rest for name, *rest in plans}
    plan, columns, options = by["rows"]
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("REBALANCE")
    assert not set(enrich.MADE_LATE) & set(by["derived"][1]) and set(enrich.MADE_LATE) <= set(columns)
    assert set(options["unlike"]) == {"contract_id", "reference", "url", "search_text"}
    assert snap.rows.where("value_band_label IS NULL OR search_text IS NULL").count() == 0


def test_many_entities_are_looked_up_by_hash(spark, monkeypatch):
    from ledgerlens.operators import stats as S
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "entity string, k int")
    stats = spark.createDataFrame([("a", 0.5, 4)], "entity string, entity_direct_rate double, entity_contracts long")
    few = S.with_entity_stats(rows, stats, S.MANY_ENTITIES)
    many = S.with_entity_stats(rows, stats, S.MANY_ENTITIES + 1)
    assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect(), key=lambda r: r.k) == sorted(few.collect(), key=lambda r: r.k)
