import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import vector_search as V
from ledgerlens.llm.queries import QUERIES


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in df])
    x = np.array([r.embedding for r in df], float)
    rows = QUERIES["op8_nearest_vectors"](spark, sf).collect()
    hits, queries = 0, ids[ids % 20 == 0]
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    for q in queries:
        near = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -near)) if ids[i] != q][:20]
        mine = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - near[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(queries)


def test_blocks_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0 + i % 3, 2.0, float(i % 5)], 1) for i in range(1, 90)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0, 0.0, 0.0], 1), (103, [nan, 1.0, 1.0], 1),
             (104, [inf, 1.0, 1.0], 1), (105, [None, 1.0, 1.0], 1), (106, [1.0], 1), (None, [1.0, 1.0, 1.0], 1),
             (20, [2.0 + 20 % 3, 2.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = V.search(df, F.col("vec_id") % 20 == 0, k=5, least=10**6, block_rows=20, query_rows=2, share=0.0).collect()
    x = {}
    for i, v, _ in rows[:89] + rows[-1:]:
        x[i] = min(x.get(i, v), v)
    for q in (20, 40, 60, 80):
        want = sorted(((-float(np.dot(x[q], v)), i) for i, v in x.items() if i != q))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(m[1], m[2]) for m in mine] == [(i, -s) for s, i in want]
    assert {r.query_id for r in got} == {20, 40, 60, 80}
    assert V.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_copies_do_not_stop_the_ascent():
    rng = np.random.default_rng(3)
    for hot in (0, 2500):
        x = rng.standard_normal((5000, 32))
        x[rng.permutation(5000)[:hot]] = x[0]
        q = x[0] + 0.5 * rng.standard_normal((20, 32))  # share the hot vector's prefixes
        longest = float(np.sqrt((x * x).sum(1).max()))
        planes = V.hyperplanes(V.lift(x[:2048], longest))
        ids, names = np.arange(5000), np.arange(9000, 9020)
        got = V.block_search(ids, x, names, q, planes, longest, 20, 0.0, 1500)
        kinds = np.unique(x, axis=0)
        mark = V.candidates(V.lift(kinds, longest), V.lift(q, longest), planes, 1500)
        assert mark.sum(1).min() >= 1500
        for i, name in enumerate(names):
            mine = got[got.query_id == name]
            assert len(mine) == 20 and mine.vec_id.is_unique
    y = np.array([[1.0, 0.0]] * 30 + [[0.5, 0.5]] * 5 + [[0.0, 1.0]])
    planes = V.hyperplanes(V.lift(y, 1.0))
    got = V.block_search(np.arange(36)[::-1], y, np.array([35]), y[:1], planes, 1.0, 32, 1.0, 3)
    assert got.vec_id.tolist() == [*range(6, 35), 1, 2, 3]


def test_candidates_are_the_rows_of_shared_prefixes():
    """The synchronous ascent against prefixes compared one by one."""
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((12, 8))
    planes = V.hyperplanes(x, trees=6, bits=11, planes=40)
    strings = [["".join("1" if v @ planes.normal[:, p] > planes.middle[p] else "0" for p in pick)
                for v in x] for pick in planes.pick]
    mine = [["".join("1" if v @ planes.normal[:, p] > planes.middle[p] else "0" for p in pick)
             for v in q] for pick in planes.pick]
    assert [[format(c, "011b") for c in row] for row in V.hash_strings(x, planes)] == strings
    for least in (1, 20, 100, 300):
        mark = V.candidates(x, q, planes, least, turns=1)
        for turns in (2, 6, 8):  # stops between two depths, with enough and no more than one more turn
            some = V.candidates(x, q, planes, least, turns)
            assert (some <= mark).all() and (some.sum(1) >= least).all()
        for i in range(len(q)):
            for depth in range(11, -1, -1):
                want = {r for t in range(6) for r in range(300) if strings[t][r][:depth] == mine[t][i][:depth]}
                if len(want) >= least:
                    break
            assert set(np.flatnonzero(mark[i])) == want
    assert V.candidates(x[:0], q, planes, 5).shape == (12, 0)


def test_recall_while_most_rows_are_not_scored(spark):
    """Two blocks of given vectors, with and without many copies of one of them."""
    from pyspark.sql import Row
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    hot = [Row(vec_id=100_001 + k, embedding=rows[3].embedding) for k in range(1000)]
    for every in (rows, rows + hot):
        df = spark.createDataFrame(every, "vec_id long, embedding array<double>")
        ids, x = np.array([r.vec_id for r in every]), np.array([r.embedding for r in every], float)
        got = {}
        for r in V.search(df, F.col("vec_id") % 20 == 0, least=100, share=0.4, block_rows=1000,
                          query_rows=30).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        queries, hits = ids[ids % 20 == 0], 0
        for q in queries:
            near = x @ x[ids == q][0]
            hits += len(got[q] & set([ids[i] for i in np.lexsort((ids, -near)) if ids[i] != q][:20]))
        assert len(got) == len(queries) and hits >= 0.9 * 20 * len(queries)
    longest = 1.0
    planes = V.hyperplanes(V.lift(x[:1500], longest))
    kinds = np.unique(x, axis=0)
    share = V.candidates(V.lift(kinds, longest), V.lift(x[:40], longest), planes, 800).mean()
    assert 0.4 <= share < 0.45


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "n-gram Jaccard join", "mixing", "best-fit packing"]
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    words = sum(len((r.text or "").encode().split()) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.sum("n_words")).first()[0] == words and sizes[2] < sizes[1] <= sizes[0] < 200


def hard_tables(folder, docs, labels, spark):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_runs_on_hard_tables(spark, docs, no_docs, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names, no rows."""
    words = [f"word{k}" for k in range(300)]

    def text(seed, n):
        return " ".join(words[(seed * 31 + k * k + 7 * k * (seed % 5 + 1)) % 300] for k in range(n))
    long = " ".join(f"word{k}" for k in range(3000))
    rows = [(200 + k, text(k, 60 + k), "en", f"s{k % 3}" if k % 4 else None) for k in range(40)]
    rows += [(None, text(77, 90), "en", "a"), (None, text(78, 90), None, None), (300, text(79, 80), "en", "a"),
             (300, text(80, 80), "en", "a"), (301, long, "en", "b"), (302, long, "en", "b")]
    every = docs.unionByName(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    sf = hard_tables(tmp_path / "a", every, [(1, 1, 0), (2, None, 1), (None, 1, 1), (2, 0, 0)], spark)
    got = corpus_pipeline.run(spark, sf).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.text_md5), []).append(r)
    assert {r.doc_id for r in got} >= {None, 300, 301} and 302 not in {r.doc_id for r in got}
    texts = {__import__("hashlib").md5((r.text or "").encode()).hexdigest(): r.text or "" for r in every.collect()}
    for (_, name), pieces in by.items():  # every piece is traced to a text, and copies are whole
        n = len(texts[name].encode().split())
        assert sum(p.n_words for p in pieces) % n == 0 and {p["size"] for p in pieces} == {n}
    assert len({name for d, name in by if d == 300}) == 2 and len({name for d, name in by if d is None}) == 2
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert corpus_pipeline.run(spark, hard_tables(tmp_path / "b", no_docs, [], spark)).count() == 0


def test_stages_on_empty_tables(spark, no_docs, tmp_path):
    sf = hard_tables(tmp_path / "c", no_docs, [], spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, sf)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == no_docs.columns)
