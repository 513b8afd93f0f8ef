import math

from pyspark.sql import functions as F

from ledgerlens.functions import formats as fm
from ledgerlens.functions.text import normalize, plain, query_words
from ledgerlens.operators.report import unique_short_labels


def one(spark, col, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_money_format(spark):
    vals = [0.0, 1234.0, 5e6, 1889133421.0, 2.5e12, -5e6, None, float("nan"), float("inf")]
    got = one(spark, fm.money(F.col("x")), [(v,) for v in vals])
    assert got == ["$0", "$1.234", "$5 M", "$1,89 mil M", "$2,50 B", "-$5 M", "—", "—", "—"]


def test_integer_format(spark):
    got = one(spark, fm.integer(F.col("x")), [(97512.0,), (105.0,), (0.0,), (None,), (-3.7,)])
    assert got == ["97.512", "105", "0", "—", "-3"]


def test_percent_text(spark):
    df = spark.range(1)
    r = df.select(fm.percent(F.lit(3), F.lit(1000)), fm.percent(F.lit(0), F.lit(1000)),
                  fm.percent(F.lit(999), F.lit(1000)), fm.percent(F.lit(5), F.lit(0))).first()
    assert tuple(r) == ("under 1%", "0%", "100%", "—")


def test_share_and_added_days_text(spark):
    r = spark.range(1).select(fm.share_text(F.lit(12.25)), fm.added_days_text(F.lit(None).cast("double")),
                              fm.added_days_text(F.lit(7.9))).first()
    assert tuple(r) == ("12,2%", "+0 d", "+7 d")


def test_short_labels_stay_distinct_and_short(spark):
    names = ["CONSTRUCTORA DEL CARIBE NORTE SAS", "CONSTRUCTORA DEL CARIBE NORTE LTDA", "SHORT",
             "CONSTRUCTORA DEL CARIBE NORTE S.A."]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
    got = [r.label for r in unique_short_labels(df, "name", "pos", 20).orderBy("pos").collect()]
    assert len(set(got)) == len(got)
    assert got[2] == "SHORT"
    assert got[0].endswith("…") and len(got[0]) <= 20
    assert got[1] == got[0] + " (2)" and got[3] == got[0] + " (3)"


def test_normalisation_matches_python_and_damaged_text(spark):
    texts = ["BOLÍVAR – CORPORACIÓN & Cía", "caf\x96e — ñandú", "", None, "ÆTHER ½"]
    got = one(spark, normalize(F.col("x")), [(t,) for t in texts], "x string")
    assert got == [plain(t) for t in texts]
    assert plain("BOLÍVAR") == "bolivar"
    assert query_words("  Hospital   NAVAL ") == ["hospital", "naval"]


def test_short_labels_avoid_suffix_collisions(spark):
    names = ["A (2)", "A", "A", "B"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "pos int, name string")
    got = [r.label for r in unique_short_labels(df, "name", "pos", 28).orderBy("pos").collect()]
    assert got == ["A (2)", "A", "A (3)", "B"]
