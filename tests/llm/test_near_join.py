from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import near_join as N
from ledgerlens.llm.queries import QUERIES

from .conftest import prose


def brute(rows, width=5, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_jaccard"](spark, sf).collect()}
    assert got == brute(rows)


def test_chains_thresholds_and_shared_passages(spark):
    rows = [(100 + i, prose(9, 80 - 4 * i) + " " + prose(50 + i, 4 * i)) for i in range(8)]  # a chain
    rows += [(200 + i, prose(20, 30) + " " + prose(60 + i, 40)) for i in range(40)]   # one passage
    for i in range(40):  # copies of one original with edits, a frequent class
        words = prose(30, 100).split()
        words[(7 * i) % 100] = f"x{i}"
        words[(13 * i + 5) % 100] = f"y{i}"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, "a b"), (401, "A  b"), (402, "a"), (403, "a"), (404, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_components(df).collect()}
    assert got == brute(rows)


def test_hard_rows(docs, no_docs):
    rows = N.near_components(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by[None].component_id is None
    assert by[4].n_shingles == by[5].n_shingles == 0 and by[5].component_id == 5
    assert by[2].component_id == by[3].component_id == 1 and by[7].component_id == 6
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        map(str, [1, 4, 5, 6, 8, 9, 10, 11, None]))
    assert N.near_components(no_docs).count() == 0
    with pytest.raises(ValueError):
        N.near_components(docs, percent=50)


def test_a_null_row_before_its_copies_hides_no_link(spark):
    near = prose(70, 90) + " tail"
    rows = [(None, prose(70, 90)), (1, prose(70, 90)), (2, near), (3, prose(71, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in N.near_components(df).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 3}


def test_rows_that_share_a_key_are_removed_only_as_copies(spark):
    a, b, c, d = (prose(k, 60) for k in (80, 81, 82, 83))
    rows = [(3, a), (5, a), (5, b), (7, b + " tail"), (9, c), (9, d), (9, d), (9, d + " tail"), (11, ""), (11, None),
            (11, ""), (None, c), (None, prose(84, 60)), (None, prose(84, 60) + " tail"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(3, a), (5, b), (9, c), (11, ""), (11, None), (None, ""), (None, None)]
    for parts in (1, 7):
        got = [(r.doc_id, r.text) for r in N.one_of_each(df.repartition(parts)).collect()]
        left = [r for r in got if r not in want]  # of equal keys any one text of a component
        assert all(got.count(r) == 1 for r in want) and len(got) == len(want) + 2
        assert sorted(str(x) for x, _ in left) == ["9", "None"]
        assert left[0][1] != left[1][1] and {t.removesuffix(" tail") for _, t in left} == {d, prose(84, 60)}
    labels = {(r.doc_id, r.component_id) for r in N.near_components(df).collect()}
    assert {(5, 3), (5, 5), (7, 5), (9, 9), (None, None)} <= labels


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    rank_of = defaultdict(int)
    world = np.unique(N._mix(np.arange(1, 4000, dtype=np.uint64)))
    for k, t in enumerate(world[::2]):
        rank_of[int(t)] = k + 1  # half of the shingles are frequent
    for _ in range(300):
        n = int(rng.integers(2, 300))
        a = rng.choice(world, n, replace=False)
        cut = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[cut:], rng.choice(world, int(rng.integers(0, n // 8 + 1)), replace=False)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        sigs = [set(N.signatures(x, np.ones(len(x), bool), np.array([rank_of[int(t)] for t in x]), 75)[0]
                    .tolist()) for x in (a, b)]
        assert sigs[0] & sigs[1]
