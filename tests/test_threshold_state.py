"""Merged states give the thresholds of one pass over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.derive import derive
from ledgerlens.operators.stats import compute_thresholds, entity_stats
from ledgerlens.operators.threshold_state import ThresholdStore, bucket
from ledgerlens.session import work_dir
from tests.fixtures import contracts


def contract_rows(n, seed):
    rnd = random.Random(seed)
    return [{"entity": rnd.choice(["A", "A", "B", "C", None, f"E{k % 9}"]),
             "modality": rnd.choice(["Contratación directa", "Licitación"]),
             "value": rnd.choice([None, 0, 1e6, -5.0, 1e6, rnd.random() * 10 ** rnd.randint(0, 13)]),
             "added": rnd.choice([None, 0, 0, rnd.randint(1, 400)]),
             "end": rnd.choice([None, -3, rnd.randint(0, 900)])} for k in range(n)]


def test_buckets_rise_with_their_values(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 1.0, 2.0, 3.0, 4.0, -1.0, 5e-324, 1e-310, 2.0 ** -1000, 1.7976931348623157e308,
          float("inf"), -float("inf")]
    xs += [math.nextafter(2.0 ** k, d) for k in range(-40, 60) for d in (0, math.inf)]
    xs += [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randint(-12, 15) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", bucket(F.col("x")).alias("b")).orderBy("x").collect()
    assert all(p.b <= q.b for p, q in zip(got, got[1:]))
    assert len({r.b for r in got}) > 2000 and all(r.b is not None for r in got)
    by = {r.x: r.b for r in got}
    assert by[1.0] != by[math.nextafter(1.0, 0)] and by[2.0] != by[math.nextafter(2.0, 0)]


@pytest.mark.parametrize("sizes", [(200, 90, 40), (150, 0), (1,), (0,), (3, 2, 1)])
def test_merged_states_equal_one_pass(spark, sizes):
    states = ThresholdStore(spark, f"{work_dir(spark)}/states-{random.random()}")
    every, names = [], []
    for k, n in enumerate(sizes):
        rows = contract_rows(n, k)
        every += rows
        states.add(f"b{k}", derive(contracts(spark, rows)))
        names.append(f"b{k}")
    all_rows = derive(contracts(spark, every))
    assert states.thresholds(names) == compute_thresholds(all_rows, entity_stats(all_rows))


def test_a_batch_can_be_replaced_or_left_out(spark):
    states = ThresholdStore(spark, f"{work_dir(spark)}/states-replace")
    a, b, c = (contract_rows(n, s) for n, s in ((80, 1), (60, 2), (70, 3)))
    for name, rows in (("a", a), ("b", b), ("b", c)):
        states.add(name, derive(contracts(spark, rows)))

    def one_pass(rows):
        d = derive(contracts(spark, rows))
        return compute_thresholds(d, entity_stats(d))
    assert states.thresholds(["a", "b"]) == one_pass(a + c) and states.thresholds(["a"]) == one_pass(a)
    assert states.has("a") and not states.has("z")
    with pytest.raises(KeyError):
        states.thresholds(["a", "z"])


def test_batches_of_the_query_read_a_stored_table(spark, monkeypatch):
    """The joins behind the contracts run once, not for every state and pass."""
    from ledgerlens.plans import queries
    rows = contract_rows(120, 5)
    ids = spark.createDataFrame([(f"K{k}",) for k in range(len(rows))], "contract_id string")
    frame = contracts(spark, rows).join(ids, "contract_id")
    plans, add = [], ThresholdStore.add

    def watched(self, batch, derived):
        plans.append(derived._jdf.queryExecution().optimizedPlan().toString())
        add(self, batch, derived)

    monkeypatch.setattr(ThresholdStore, "add", watched)
    monkeypatch.setattr(queries, "contracts_from_tables", lambda spark, sf: frame)
    got = queries.q_thresholds_after_append(spark, "unused").first()
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    d = derive(frame)
    want = compute_thresholds(d, entity_stats(d))
    assert (got.t_value, got.t_added, got.t_direct, got.n_rows) == (
        want.t_value, want.t_added, want.t_direct, want.n_rows)
