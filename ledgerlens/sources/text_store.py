"""Stored normalised texts with an index, for searches over documents.

Normalising needs a Python worker, so it is done once per version of the
table: the store holds ``id, lang, norm`` with trigram postings beside it,
and a search reads only files that can hold the words.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..session import ship_package
from . import manifest, search_index
from . import snapshot as store

STORE_VERSION = "1"


def open_store(spark: SparkSession, path: str, text: str, keep: Sequence[str]) -> str:
    """Folder of the published store of the table at ``path``; built where it is missing."""
    ship_package(spark)
    columns = {manifest.origin_of(path): tuple([*keep, text])}
    version = manifest.version_of(spark, [path], columns)
    base = store.snapshot_dir(spark, store.snapshot_key(version, f"texts:{text}:{','.join(keep)}", STORE_VERSION))
    folder = store.current_attempt(spark, base)
    if folder is None:
        folder = f"{base}/attempt-{uuid.uuid4().hex[:12]}"
        rows = spark.read.parquet(path).select(*keep, normalize(F.col(text)).alias("norm"))
        store.write_parquet(rows, f"{folder}/texts")
        search_index.write_index(spark, f"{folder}/texts", "norm", f"{folder}/grams")
        store.publish(spark, base, folder)
    return folder


def search_texts(spark: SparkSession, path: str, text: str, keep: Sequence[str], query: str) -> DataFrame:
    """``*keep, norm`` of the rows whose normalised text holds every word of the query."""
    folder = open_store(spark, path, text, keep)
    table = spark.read.parquet(f"{folder}/texts")
    return search_index.search(spark, table, f"{folder}/texts", f"{folder}/grams", "norm", query)
