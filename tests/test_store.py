"""Manifest, publishing and the trigram index."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import enrich, views
from ledgerlens.plans.views import ViewSpec
from ledgerlens.session import work_dir
from ledgerlens.sources import manifest, search_index, text_store
from ledgerlens.sources import snapshot as store
from tests.fixtures import buyers, contracts


def files(folder):
    return sorted(f for f in glob.glob(f"{folder}/*.parquet"))


def test_manifest_names_the_content(spark, tmp_path):
    df = contracts(spark, buyers())
    a, b = str(tmp_path / "v" / "contracts"), str(tmp_path / "w" / "contracts")
    df.repartition(3).write.parquet(a)
    df.orderBy(F.desc("value")).coalesce(1).write.parquet(b)
    one, two = (manifest.dataset_version(manifest.refresh(spark, [p])).first() for p in (a, b))
    assert (one.origin, one.n_files, one.n_rows) == ("contracts", 3, 195) and two.n_files == 1
    assert one.bytes == sum(os.path.getsize(f) for f in files(a))
    assert (one.fingerprint, one.version) == (two.fingerprint, two.version)  # the same rows
    assert manifest.version_of(spark, [a]) == one.version
    df.limit(1).write.mode("append").parquet(a)
    more = manifest.dataset_version(manifest.refresh(spark, [a])).first()
    assert more.n_rows == 196 and more.fingerprint != one.fingerprint and more.n_files == 4
    assert manifest.version_of(spark, [a]) == more.version != one.version


def test_known_files_are_not_read_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(50).repartition(4).write.parquet(path)
    manifest.refresh(spark, [path]).collect()
    asked = []
    real = manifest.file_hashes
    monkeypatch.setattr(manifest, "file_hashes", lambda s, p, c=(), f=(): asked.append(len(f)) or real(s, p, c, f))
    assert manifest.refresh(spark, [path]).agg(F.sum("n_rows")).first()[0] == 50 and asked == []
    spark.range(7).coalesce(1).write.mode("append").parquet(path)
    assert manifest.refresh(spark, [path]).agg(F.sum("n_rows")).first()[0] == 57 and asked == [1]
    monkeypatch.setattr(manifest, "FEW_FILES", 0)  # too many to name: all are hashed
    spark.range(3).coalesce(1).write.mode("append").parquet(path)
    assert manifest.refresh(spark, [path]).agg(F.sum("n_rows")).first()[0] == 60 and asked == [1, 0]


def test_chosen_columns_and_equal_rows_count(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.lit(1).alias("a"), F.col("id").alias("b")).write.parquet(path)
    narrow = manifest.file_hashes(spark, path, ["a"]).agg(F.sum("hash_sum")).first()[0]
    one = spark.range(1).select(F.xxhash64(F.lit(1))).first()[0]
    assert narrow == 10 * one  # equal rows add up


def test_a_reader_never_finds_a_gap(spark):
    base = f"{work_dir(spark)}/ledgerlens/publish-test"
    store.publish(spark, base, f"{base}/attempt-0")
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(store.current_attempt(spark, base))
    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 6):
        store.publish(spark, base, f"{base}/attempt-{k}")
    stop.set()
    reader.join()
    assert None not in seen and store.current_attempt(spark, base) == f"{base}/attempt-5"


def test_old_attempts_and_work_tables_are_removed(spark):
    df = contracts(spark, buyers())
    snaps = [enrich.build(spark, df, "upkeep-test") for _ in range(3)]
    enrich._LOADED.pop("upkeep-test", None)
    assert [store.exists(spark, s.path) for s in snaps] == [False, True, True] or len(
        {s.path for s in snaps}) < 3
    now = enrich.load(spark, "upkeep-test")
    assert not store.exists(spark, f"{now.path}/derived") and now.rows.count() == 195


@pytest.fixture(scope="module")
def snap(spark):
    rows = [{"entity": f"Office {k % 40}", "modality": "L", "value": 1e6 + k, "ref": f"file {k}",
             "signed": 365 * (k % 9)} for k in range(400)]
    rows[7] |= {"entity": "Hospital Naval de la Región"}
    return enrich.build_from_frame(contracts(spark, rows))


@pytest.mark.parametrize("query", ["hospital NAVAL", "región", "office 3", "ce 17", "o", "", "  ",
                                   "no such words", "naval office", "file 399", "á é"])
def test_search_through_the_index_equals_the_scan(snap, query):
    got = snap.view(ViewSpec(query=query, years=(2023, 2030))).select("reference", "is_anomaly").collect()
    want = views.apply_view(snap.rows, ViewSpec(query=query, years=(2023, 2030))).select(
        "reference", "is_anomaly").collect()
    assert sorted(got) == sorted(want)


def test_a_rare_word_reads_few_files(spark, snap):
    every, few = snap.raw_rows.inputFiles(), snap.search("hospital naval").raw_rows.inputFiles()
    assert len(every) >= 8 and len(few) == 1
    assert snap.search("zzzz").raw_rows.inputFiles() == [] or snap.search("zzzz").rows.count() == 0
    assert len(snap.search("ab").raw_rows.inputFiles()) == len(every)  # no trigram: a scan
    assert search_index.candidate_files(spark, f"{snap.path}/grams", ["office"], few=2) is None


def test_postings_hold_each_pair_once(spark, snap):
    index = spark.read.parquet(f"{snap.path}/grams")
    assert index.count() == index.distinct().count()
    texts = [r.search_text for r in snap.raw_rows.select("search_text").collect()]
    assert {r.gram for r in index.select("gram").collect()} == set().union(*map(search_index.grams, texts))


def test_text_store_follows_the_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(k, "en", t) for k, t in enumerate(["Élle a ouèst", "elle seule", None, "", "OUE ELLE", "ouelle"])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3).write.parquet(path)

    def found(query):
        return sorted(r.doc_id for r in text_store.search_texts(
            spark, path, "text", ("doc_id", "lang"), query).collect())
    assert found("Élle ouè") == [0, 4, 5] and found("seule") == [1] and found("nothing") == []
    first = text_store.open_store(spark, path, "text", ("doc_id", "lang"))
    assert text_store.open_store(spark, path, "text", ("doc_id", "lang")) == first
    spark.createDataFrame([(9, "fr", "SEULE")], "doc_id long, lang string, text string").write.mode(
        "append").parquet(path)
    assert found("seule") == [1, 9] and len(found("")) == 7


def test_pinned_versions_name_their_dataset(spark, tmp_path):
    from ledgerlens.plans import facts
    from ledgerlens.sources.contracts import SOURCE_COLUMN_NAMES
    df = contracts(spark, buyers())
    src = df.select(*[F.col(c).alias(SOURCE_COLUMN_NAMES[c]) for c in df.columns])
    base = str(tmp_path / "contracts")
    src.coalesce(1).write.parquet(f"{base}/2026-11")
    src.limit(100).coalesce(1).write.parquet(f"{base}/2026-12")
    old, new = (enrich.snapshot_of(spark, base, v) for v in ("2026-11", "2026-12"))
    a, b = old.dataset().first(), new.dataset().first()
    assert (a.origin, a.n_rows, b.origin, b.n_rows) == ("2026-11", 195, "2026-12", 100)
    assert a.bytes == sum(os.path.getsize(f) for f in files(f"{base}/2026-11")) and a.version != b.version
    assert old.identified(facts.kpis(old.rows)).first().dataset_version == a.version
    again = enrich.snapshot_of(spark, base, "2026-11")
    assert again.path == old.path and again.rows.count() == 195  # the pin is not built twice
    assert enrich.build_from_frame(df).dataset() is None


def test_ascii_texts_are_normalised_and_indexed_by_the_batch(monkeypatch):
    import pyarrow as pa
    from ledgerlens.functions import text
    from ledgerlens.sources import search_index

    texts = [None, "", "ab", "abc", "xAbc1", "éa fi b", "bc", "c\x00d|", "abcd"]
    files = ["f", "f", "f", "f", "g", "g", "g", "h", "h"]
    want = {}
    for t, f in zip(texts, files):
        for g in search_index.grams(t or ""):
            want.setdefault(f, set()).add(g)
    lowered = [text.plain(t) for t in texts]
    slow = []  # texts that are looked at one by one

    def watched(kernel):
        return lambda t: slow.append(t) or kernel(t)

    monkeypatch.setattr(search_index, "grams", watched(search_index.grams))
    monkeypatch.setattr(text, "plain", watched(text.plain))
    rows = pa.record_batch([pa.array(files), pa.array(texts)], ["file", "text"])
    got = [(f, g) for b in search_index._postings(iter([rows.slice(0, 2), rows.slice(2, 6), rows.slice(8)]))
           for f, g in zip(b.column("file").to_pylist(), b.column("gram").to_pylist())]
    assert len(got) == len(set(got)) and {(f, g) for f in want for g in want[f]} == set(got)
    assert text.normalize.func(pa.array(texts)).to_pylist() == lowered
    assert set(slow) == {"éa fi b"}
