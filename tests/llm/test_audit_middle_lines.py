"""Filter audit, fill-in-middle and line removal against plain Python and DuckDB."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import fill_middle, filter_audit, line_dedup
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op3_ngram_jaccard", "op9_quality_rules", "op11_filter_audit",
                                  "op12_fill_middle", "op13_line_dedup"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(
        index=False, name=None))) for x in (got, want))
    assert a == b


# -- filter audit -----------------------------------------------------------

ids = st.lists(st.integers(0, 40), max_size=30).map(lambda x: sorted(set(x)))


@settings(max_examples=150, deadline=None)
@given(st.lists(ids, max_size=4), ids)
def test_galloping_merges_equal_sets(lists, other):
    assert filter_audit.union(lists) == sorted(set().union(*lists))
    for x in lists:
        assert filter_audit.difference(x, other) == sorted(set(x) - set(other))


def audit_by_hand(rows, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    docs = []
    for d, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        docs.append((source or "", d in good, d in toxic, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d}))
    out, shapley = [], Counter()
    for part in {x[0] for x in docs}:
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [x for x in left if x[3][f]]
                redundant = sum(x[3][f] for x in gone)
                left, gone = [x for x in left if not x[3][f]], gone + lost
                single = sum(x[0] == part and x[3][f] and sum(x[3].values()) == 1 for x in docs)
                shapley[part, f] += len(lost)
                out.append((part, "".join(order), step, f, len(left), len(lost), redundant, single,
                            sum(x[1] for x in lost), sum(x[2] for x in lost)))
    return sorted((*r[:3], *r[4:], shapley[r[0], r[3]]) for r in out)


def test_audit_of_hard_rows(spark, docs, no_docs):
    labels = [(1, 1, 0, "x"), (2, 0, 1, "x"), (2, 1, None, "x"), (None, 1, 1, "x"), (8, 1, 1, None)]
    extra = [(20 + k, "A # B " * 120 if k % 3 else "same words", "s", "hot" if k % 4 else None)
             for k in range(40)] + [(7, "same words", "s", "hot")] * 9 + [(None, "same words", "s", "hot")]
    more = spark.createDataFrame([(d, t, s) for d, t, _, s in extra], "doc_id long, text string, source string")
    every = docs.unionByName(more, allowMissingColumns=True).repartition(5)
    got = filter_audit.filter_audit(every, spark.createDataFrame(labels, LABELS))
    rows = [(r.doc_id, r.text, r.source) for r in every.collect()]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, labels)
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(no_docs, none).count() == 0
    assert filter_audit.filter_audit(docs, none).count() == 600 * 4


# -- fill in the middle -----------------------------------------------------

def middle_by_hand(doc_id, text, fim_rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def middle_rows(spark, docs):
    lines = [(30 + k, "\n" * (k % 3) + "".join(f"line {i} é\n" for i in range(k)) + "end" * (k % 2))
             for k in range(30)]
    lines += [(70, "a\nb<P>\nc"), (71, "\n"), (72, "\n\n\nx"), (73, "ü" * 200_000 + "\n" + "y" * 70_000),
              (74, "".join(f"{i} lines\n" for i in range(30_000)))]
    lines += [(75, "again\nand again\n")] * 60 + [(None, "no id\nat all")] * 3 + [(None, "other\ntext")]
    more = spark.createDataFrame(lines, "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True)


@pytest.mark.parametrize("kw", [{}, {"fim_rate": 40, "spm_rate": 0}])
def test_fill_in_middle_of_hard_rows(spark, docs, no_docs, kw):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # repeated rows meet again
    try:
        every = middle_rows(spark, docs).repartition(4)
        got = fill_middle.fill_in_middle(every, **kw)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                               "restored_sha256"]
        want = [middle_by_hand(r.doc_id, r.text, **kw) for r in every.select("doc_id", "text").collect()]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert fill_middle.fill_in_middle(no_docs).count() == 0


def test_pieces_are_bounded_and_sorted(spark, docs):
    by = defaultdict(list)
    for r in fill_middle.pieces(middle_rows(spark, docs)).toLocalIterator():
        if r.head is None:
            by[bytes(r.doc), r.lane].append((r.at, bytes(r.data)))
    assert all(v == sorted(v) for v in by.values())
    assert max(len(d.decode()) for v in by.values() for _, d in v) <= fill_middle.PIECE
    texts = {b"".join(d for _, d in v) for v in by.values()}
    assert any(b"<P>" in t and t.count(b"lines\n") == 30_000 for t in texts)


def test_repeated_rows_are_counted_before_the_shuffle(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, "a\nb\n").otherwise("c\nd").alias("text"))
    n = fill_middle.pieces(rows.repartition(4)).filter("head IS NOT NULL").count()
    assert n <= 2000 + 4 and fill_middle.fill_in_middle(rows).count() == 3000


# -- lines ------------------------------------------------------------------

def lines_by_hand(rows, min_docs, keep_first=False, min_chars=1):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= max(min_chars, 1) else None
    holders, order = defaultdict(set), {}
    for d, text in rows:
        rank = (d is None, d or 0, hashlib.sha256(f"{'' if d is None else d}:{text or ''}".encode()).digest()[:16])
        for at, line in enumerate((text or "").split("\n")):
            k = key(line)
            if k is not None:
                holders[k].add((d, text or ""))
                order[k] = min(order.get(k, (rank, at)), (rank, at))
    out = []
    for d, text in rows:
        rank = (d is None, d or 0, hashlib.sha256(f"{'' if d is None else d}:{text or ''}".encode()).digest()[:16])
        lines = (text or "").split("\n")
        stay = [x for at, x in enumerate(lines) if len(holders.get(key(x), ())) < min_docs
                or (keep_first and order[key(x)] == (rank, at))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def line_rows(spark, docs):
    rows = [(100 + k, f"own {k}\n  Common LINE \n\ncommon line\nevery {k % 3}\nÄ\n{'few' if k < 4 else k}")
            for k in range(60)]
    rows += [(9, "repeated row\ncommon line")] * 40 + [(None, "no id\nfew"), (None, "no id\nfew"), (None, "few\nÄ")]
    rows += [(300, "\n".join(["many times"] * 5000 + ["few"])), (301, "x \r\n\tfew\x0b\n"), (302, "\n")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True).repartition(6)


@pytest.mark.parametrize("kw", [{"min_docs": 10}, {"min_docs": 3}, {"min_docs": 2, "keep_first": True},
                                {"min_docs": 3, "min_chars": 4}])
def test_lines_of_hard_rows(spark, docs, no_docs, kw):
    every = line_rows(spark, docs).cache()
    got = line_dedup.drop_lines(every, **kw)
    seen = sorted(repr((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode())) for r in got.collect())
    assert seen == lines_by_hand([(r.doc_id, r.text) for r in every.collect()], **kw)
    assert line_dedup.drop_lines(no_docs).count() == 0


def test_a_very_common_line_spans_ranges(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the same line\nown "), F.col("id").cast("string")).alias("text"))
    lines = line_dedup.sorted_lines(docs)
    per = [r["count"] for r in lines.groupBy("range").count().collect()]
    assert max(per) <= 3 * sorted(per)[len(per) // 2]
    shared = line_dedup.across_borders(lines)
    assert [v[0] for v in shared.values()] == [n]
    got = line_dedup.drop_lines(docs, keep_first=True).filter("n_dropped = 0").collect()
    assert [(r.doc_id, bytes(r.kept)) for r in got] == [(0, b"the same line\nown 0")]


@given(st.lists(st.booleans(), min_size=1, max_size=300))
def test_bitmap_round_trip(keep):
    packed = line_dedup.pack_bitmap(len(keep), [k for k, x in enumerate(keep) if not x])
    assert line_dedup.unpack_bitmap(len(keep), packed).tolist() == keep
