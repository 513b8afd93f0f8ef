"""Positions and labels over lists of any length, held against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import with_position
from ledgerlens.operators.report import short_labels, top_n_with_other, unique_short_labels


def test_positions_in_groups_with_ties(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 11).alias("v"), "id").repartition(6)
    got = with_position(df, ["g"], [F.desc("v")]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.pos, r.v))
    assert len(got) == 5000
    for rows in by.values():
        rows.sort()
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)
    assert with_position(df.limit(0), ["g"], [F.col("v")]).count() == 0
    assert sorted(r.pos for r in with_position(df, [], [F.col("v")]).collect()) == list(range(1, 5001))


def test_equal_rows_spread_over_ranges(spark):
    """A third of the rows equal in group and order: no range holds much more than the others."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    pos = with_position(df, [], [F.col("v")])
    sizes = sorted(len(p) for p in pos.select("pos").rdd.glom().collect() if p)
    assert sorted(r.pos for r in pos.select("pos").collect()) == list(range(1, 30_001))
    ranges = sorted(r["count"] for r in df.withColumn("_salt", F.monotonically_increasing_id())
                    .repartitionByRange(8, "v", "_salt").groupBy(F.spark_partition_id()).count().collect())
    assert ranges[-1] <= 3 * ranges[len(ranges) // 2] and sum(sizes) == 30_000


def by_hand(names, n):
    taken, out = set(), []
    for name in names:
        short = name if len(name) <= n else name[:n - 1].rstrip() + "…"
        k, label = 1, short
        while label in taken:
            k += 1
            label = f"{short} ({k})"
        taken.add(label)
        out.append(label)
    return out


@pytest.mark.parametrize("names", [
    ["alpha beta one", "alpha beta two", "gamma", "alpha beta two", "alpha beta 3"],
    ["abc", "abc (2)", "abc", "abc", "abc (2)", "abc (2) (2)", "abc (3)", "x (1)", "x", "x"],
    [f"{'same start of name' if k % 3 else 'other'} {k}" for k in range(400)] + ["same star… (2)"] * 3,
    [],
])
def test_labels_follow_the_sequential_rule(spark, names):
    rows = list(enumerate(names, 1))
    df = spark.createDataFrame(rows, "rank int, name string").repartition(4)
    want = by_hand(names, 10)
    got = {r["rank"]: r["label"] for r in short_labels(df, "name", "rank", 10).collect()}
    assert [got[k] for k, _ in rows] == want
    if len(names) < 50:
        old = {r["rank"]: r["label"] for r in unique_short_labels(df, "name", "rank", 10).collect()}
        assert [old[k] for k, _ in rows] == want
    assert not Counter(got.values()) or max(Counter(got.values()).values()) == 1


def test_top_list_without_a_window_over_all_groups(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 97).alias("n"))
    got = top_n_with_other(df, "k", "n", 5, [F.desc("n"), F.col("k")])
    rows = {r["rank"]: r for r in got.collect()}
    assert len(rows) == 6 and rows[6].is_other
    assert sum(r.n for r in rows.values()) == df.agg(F.sum("n")).first()[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "GlobalLimit" in plan  # numbers the five that are left
    few = top_n_with_other(df.limit(3), "k", "n", 5, [F.desc("n"), F.col("k")])
    assert few.where("is_other").count() == 0 and few.count() == 3
