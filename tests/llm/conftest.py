import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 37 + i * i * 7 + i * (seed % 11 + 1)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Small hard table: nulls in every column, empty and long texts, ties, repeats, clashing names."""
    base = prose(1, 60)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail end", "en", "b", 1),
            (4, "", "en", "b", 0), (5, None, None, None, None), (6, "one two", "de", "a", 7),
            (7, "ONE Two", "de", None, 7), (8, prose(2, 4000), "en", "a", 9),
            (9, prose(3, 50), None, "c", 9), (None, prose(4, 30), "fr", "c", 9),
            (10, "Licensed under the Apache License, Version 2.0. " + prose(5, 20), "en", "b", 1),
            (11, prose(6, 6) + "\n" + prose(6, 6) + "\n\n x", "en", "b", 1),
            (11, prose(6, 6) + "\n" + prose(6, 6) + "\n\n x", "en", "b", 1)]
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], DOCS)
    return df.withColumn("keep", F.lit("x")).withColumn("pos", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)
