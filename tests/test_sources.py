import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import enrich
from ledgerlens.sources.contracts import SOURCE_COLUMN_NAMES, load_contracts
from ledgerlens.sources.export import EXPORT_COLUMNS, write_csv
from ledgerlens.sources.fingerprint import fingerprint
from tests.fixtures import contracts, buyers


def test_source_names_and_pinned_versions(spark, tmp_path):
    df = contracts(spark, buyers())
    src = df.select(*[F.col(c).alias(SOURCE_COLUMN_NAMES[c]) for c in df.columns])
    src.write.parquet(str(tmp_path / "v1"))
    src.limit(10).write.parquet(str(tmp_path / "v2"))
    latest = load_contracts(spark, str(tmp_path / "v2"))
    pinned = load_contracts(spark, str(tmp_path), version="v1")
    assert latest.count() == 10 and pinned.count() == 195
    assert "entity" in pinned.columns and pinned.where("process_url IS NOT NULL").count() == 0


def test_fingerprint_ignores_order_but_not_content(spark):
    df = contracts(spark, buyers())
    a = fingerprint(df).first()
    b = fingerprint(df.orderBy(F.desc("value")).repartition(3)).first()
    c = fingerprint(df.limit(194)).first()
    assert a.fingerprint == b.fingerprint and a.n_rows == 195
    assert c.fingerprint != a.fingerprint
    dup = fingerprint(df.unionByName(df)).first()  # equal rows must not cancel out
    assert dup.fingerprint != a.fingerprint and dup.hash_sum != "0"


def test_export_writes_every_flagged_row(spark, tmp_path):
    snap = enrich.build_from_frame(contracts(spark, buyers()))
    out = str(tmp_path / "export")
    write_csv(snap.rows, out)
    back = spark.read.option("header", True).csv(out)
    assert tuple(back.columns) == EXPORT_COLUMNS
    assert back.count() == snap.rows.where("rule_priority OR is_anomaly").count()
