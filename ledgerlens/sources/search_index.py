"""Word search through trigram postings (F1).

For every trigram of a normalised text column the index holds the files of
the stored table in which it occurs.  A word can only stand in a file that
has all of the word's trigrams, so a search intersects their postings, reads
the files that are left and verifies the words there.  A word of one or two
characters has no trigram and is only verified.

The index of a table of F files has at most F rows for a trigram; a task
holds the trigrams of one file at a time.  Where ``FEW_FILES`` are not
enough, the words are so common that the index can't help, and the whole
table is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_all_words, query_words

GRAM = 3
FEW_FILES = 10_000


def grams(text: str) -> set[str]:
    return {text[k:k + GRAM] for k in range(len(text) - GRAM + 1)}


class _Found:
    """The trigrams of a file: a bitmap of the ASCII ones, a set of those in other texts."""

    def __init__(self):
        self.seen, self.others = np.zeros(1 << 21, dtype=bool), set()

    def add(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        beyond = pc.invert(pc.string_is_ascii(texts))
        for text in texts.filter(beyond).to_pylist():
            self.others |= grams(text)
        texts = texts.filter(pc.invert(beyond))
        _, ends, data = texts.buffers()
        if not len(texts) or data is None:
            return
        ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        b = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].astype(np.int32)
        if len(b) < GRAM:
            return
        inside = np.ones(len(b), dtype=bool)  # no trigram begins at the end of a text
        for k in range(1, GRAM):
            inside[np.maximum(ends[1:] - ends[0] - k, 0)[ends[1:] - ends[0] >= k]] = False
        codes = (b[:-2] << 14) | (b[1:-1] << 7) | b[2:]
        self.seen[codes[inside[:-2]]] = True

    def all(self) -> set[str]:
        return self.others | {chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127)
                              for c in np.flatnonzero(self.seen).tolist()}


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``gram, file`` once per file that the task reads."""
    def batch(file: str, found: set[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found, pa.string()), pa.array([file] * len(found), pa.string())],
                               ["gram", "file"])
    last, found = None, _Found()
    for b in batches:
        runs, start = pc.run_end_encode(b.column("file").cast(pa.string())), 0
        for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if file != last:
                if every := found.all():
                    yield batch(last, every)
                last, found = file, _Found()
            found.add(b.column("text").slice(start, end - start))
            start = end
    if every := found.all():
        yield batch(last, every)


def _inside(table: str) -> Column:
    """Path of a row's file inside the folder of its table."""
    return F.substring_index(F.col("_metadata.file_path"), f"/{table}/", -1)


def write_index(spark: SparkSession, table_path: str, column: str, out_path: str) -> None:
    """Writes the postings of ``column`` of a stored table, sorted by trigram."""
    name = table_path.rstrip("/").rsplit("/", 1)[-1]
    rows = spark.read.parquet(table_path).select(_inside(name).alias("file"), F.col(column).alias("text"))
    found = rows.mapInArrow(_postings, "gram string, file string").distinct()
    (found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram", "file")
     .sortWithinPartitions("gram", "file").write.parquet(out_path))


def candidate_files(spark: SparkSession, index_path: str, words: Sequence[str],
                    few: int = FEW_FILES) -> list[str] | None:
    """The files that may hold all ``words``, or None where the index can't tell.

    Equal comparisons reach the sorted scan, so only the row groups of these
    trigrams are read.
    """
    wanted = sorted(set().union(*[grams(w) for w in words])) if words else []
    if not wanted:
        return None
    any_of = reduce(lambda a, b: a | b, [F.col("gram") == g for g in wanted])
    hits = (spark.read.schema("gram string, file string").parquet(index_path).where(any_of)
            .groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)))
    names = [r["file"] for r in hits.select("file").limit(few + 1).collect()]
    return names if len(names) <= few else None


def narrowed(spark: SparkSession, table: DataFrame, table_path: str, index_path: str,
             query: str | None) -> DataFrame:
    """``table``, stored at ``table_path``, without the files that can't hold all words of a query."""
    files = candidate_files(spark, index_path, query_words(query))
    if files is None:
        return table
    if not files:
        return table.where(F.lit(False))
    reader = spark.read.schema(table.schema).option("basePath", table_path)
    return reader.parquet(*[f"{table_path}/{f}" for f in files])


def search(spark: SparkSession, table: DataFrame, table_path: str, index_path: str, column: str,
           query: str | None) -> DataFrame:
    """The rows of a stored table whose ``column`` holds every word of the query."""
    found = contains_all_words(F.col(column), query)
    rows = narrowed(spark, table, table_path, index_path, query)
    return rows if found is None else rows.where(found)
