"""Removal of lines that many documents share.

Every line has a key (white space stripped at both ends, A-Z lower-cased).
The keys' hashes are dealt by ranges of (hash, document) and sorted by hash,
document and position, so that a task streams the occurrences of each key in
order, first ones first, and counts its documents.  A very common line spans
several ranges; the documents of the few keys that lie across a border are
counted once more and sent to all tasks (at most one key a border).  What
comes back for a document is not text but a compressed bitmap of the lines
that stay.

A document is a doc_id with a text, so rows that repeat both count once for
a key and lose the same lines; texts of one doc_id, or of none, that differ
are documents of their own.  Null doc_ids come last in order.  A null or
empty text is one empty line; lines with an empty key always stay.  Texts of
any length are read whole, one batch at a time.  An empty table gives an
empty result.  Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ready, shuffle_width

MIN_DOCS = 10  # documents that must hold a key
MIN_CHARS = 1  # code points of a key that counts
FLUSH = 1 << 17  # rows that a task gathers for one Arrow batch

_LINES = "line binary, doc_id long, doc binary, n_lines int, at int"
_GONE = pa.schema([("doc", pa.binary()), ("n_lines", pa.int32()), ("at", pa.int32())])
_KEPT = pa.schema([("doc", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                   ("keep", pa.binary())])


def line_key(line: bytes) -> bytes:
    """Bytes are stripped of ASCII white space and lower-cased in A-Z only."""
    return line.strip().lower()


def _doc() -> Column:
    """128 bits that name a document."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                     F.coalesce("text", F.lit("")))
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def _rows(docs: DataFrame) -> DataFrame:
    ready(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, out = set(), ([], [], [], [], [])

            def batch(out: tuple) -> pa.RecordBatch:
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)],
                                       [c.split()[0] for c in _LINES.split(", ")])
            names, ids = b.column("doc").to_pylist(), b.column("doc_id").to_pylist()
            for doc, doc_id, text in zip(names, ids, b.column("text")):
                if doc in seen:
                    continue
                seen.add(doc)
                lines = text.as_py().split(b"\n")
                for at, line in enumerate(lines):
                    key = line_key(line)
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        for col, x in zip(out, (hashlib.blake2b(key, digest_size=16).digest(),
                                                doc_id, doc, len(lines), at)):
                            col.append(x)
                if len(out[0]) >= FLUSH:
                    yield batch(out)
                    out = ([], [], [], [], [])
            if out[0]:
                yield batch(out)
    return run


def sorted_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``line, doc_id, doc, n_lines, at, range``: the lines' hashes in order, range by range.

    All occurrences of a key in a document lie in one range.
    """
    order = ["line", F.col("doc_id").asc_nulls_last(), "doc"]
    lines = _rows(docs).mapInArrow(_lines(min_chars), _LINES)
    return cut(lines.repartitionByRange(shuffle_width(docs.sparkSession), *order)
               .sortWithinPartitions(*order, "at").withColumn("range", F.spark_partition_id()))


def _count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``line, range, n``: documents of each key of a sorted range."""
    last, n, where = None, Counter(), 0
    for b in batches:
        for line, doc, where in zip(*[b.column(c).to_pylist() for c in ("line", "doc", "range")]):
            n[line] += (line, doc) != last
            last = (line, doc)
    yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array([where] * len(n), pa.int32()),
                           pa.array(list(n.values()), pa.int64())], ["line", "range", "n"])


def across_borders(lines: DataFrame) -> dict[bytes, tuple[int, int]]:
    """Documents and first range of the keys that more than one range holds.

    A range shares at most its first and its last key with others, so there
    are fewer of them than ranges.
    """
    ends = lines.groupBy("range").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    held = ends.select("range", F.explode(F.array_distinct(F.array("low", "high"))).alias("line"))
    shared = held.groupBy("line").agg(F.count("*").alias("n")).filter("n > 1")
    keys = [bytes(r["line"]) for r in shared.select("line").collect()]  # fewer than ranges
    if not keys:
        return {}
    some = lines.filter(F.col("line").isin(keys)).select("line", "doc", "range")
    counts = some.mapInArrow(_count_docs, "line binary, range int, n long").groupBy("line").agg(
        F.sum("n").alias("n"), F.min("range").alias("range"))
    return {bytes(r["line"]): (r["n"], r["range"]) for r in counts.collect()}


def _stream(min_docs: int, keep_first: bool, shared: dict):
    """The lines that go, from the occurrences in order.

    Until a key is known to be common, the occurrences of its first
    ``min_docs - 1`` documents are held.
    """
    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, doc, n, common, first, held = None, None, 0, False, None, []
        for b in batches:
            for line, d, n_lines, at, where in zip(*[b.column(c).to_pylist() for c in (
                    "line", "doc", "n_lines", "at", "range")]):
                if line != key:
                    key, doc, n, held = line, None, 0, []
                    total, at_range = shared.get(line, (0, where))
                    common, first = total >= min_docs, (d, at) if at_range == where else None
                n += d != doc
                doc = d
                if keep_first and (d, at) == first:
                    continue
                if common:
                    yield d, n_lines, at
                else:
                    held.append((d, n_lines, at))
                    if n >= min_docs:
                        yield from held
                        common, held = True, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for row in gone(batches):
            some.append(row)
            if len(some) >= FLUSH:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), _GONE.types)], schema=_GONE)
                some = []
        if some:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), _GONE.types)], schema=_GONE)
    return run


def pack_bitmap(n_lines: int, gone: list[int]) -> bytes:
    """The lines that stay as compressed bits."""
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bitmap(n_lines: int, keep: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, gone = b.column("n_lines").to_pylist(), b.column("gone").to_pylist()
        yield pa.record_batch(
            [b.column("doc"), pa.array(n_lines, pa.int64()), pa.array([len(g) for g in gone], pa.int64()),
             pa.array([pack_bitmap(n, g) for n, g in zip(n_lines, gone)], pa.binary())], schema=_KEPT)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep_first: bool = False) -> DataFrame:
    """``doc, n_lines, n_dropped, keep`` of the documents that lose lines.

    A key that ``min_docs`` documents hold loses all its lines, or with
    ``keep_first`` all but the first line of its first document.
    """
    lines = sorted_lines(docs, min_chars)
    shared = across_borders(lines)
    gone = lines.mapInArrow(
        _stream(min_docs, keep_first, shared), "doc binary, n_lines int, at int")
    return (gone.groupBy("doc").agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("gone"))
            .mapInArrow(_bitmaps, "doc binary, n_lines long, n_dropped long, keep binary"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_lines", "n_dropped", "kept"]
    for b in batches:
        n, n_gone, out = [], [], []
        for text, keep in zip(b.column("text"), b.column("keep").to_pylist()):
            lines = text.as_py().split(b"\n")
            stay = lines
            if keep is not None:
                stay = [x for x, k in zip(lines, unpack_bitmap(len(lines), keep)) if k]
            n.append(len(lines))
            n_gone.append(len(lines) - len(stay))
            out.append(b"\n".join(stay))
        yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()),
                               pa.array(n_gone, pa.int64()), pa.array(out, pa.binary())], names)


def drop_lines(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept`` (the text that stays, UTF-8).

    Repeated rows make the text side of the join uneven; adaptive execution
    splits such partitions.
    """
    marked = _rows(docs).join(keep_bitmaps(docs, **kw).select("doc", "keep"), "doc", "left")
    return marked.select("doc_id", "text", "keep").mapInArrow(
        _apply, "doc_id long, n_lines long, n_dropped long, kept binary")
