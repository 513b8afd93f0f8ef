"""Audit of how filters interact: what each removes in every order.

Every document fails some of five filters.  Per part (source) the ids of
the documents that fail a filter form a sorted posting list.  For every set
of filters that may come first, unions and differences of the lists are
computed by galloping merges over one id range at a time, and the sizes
summed; all orders are then put together from those sums.

The rows are dealt by ranges of (part, id) and sorted, so a part of any
size spreads over many tasks, and a task holds one range of at most an
Arrow batch of rows.  Equal texts are found by their digests: each digest's
ids are first reduced in ``SALTS`` groups, so no text fills a task; rows that
agree in all that counts are joined into one with a weight before that.

A null text is empty, a null source is the part ``''``.  A row without
doc_id has no smaller doc_id, makes no other row a copy and has no labels.
Repeated rows are separate documents that share a doc_id, so none of them
is the other's copy.  A doc_id that is labelled more than once counts as
good or toxic if any label says so.  Texts of any length are read whole, one
batch at a time.  An empty table gives an empty result.  Columns other than
those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import groupby, permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready, shuffle_width

FILTERS = "ABCDE"
MIN_WORDS = 200      # A: fewer words
MIN_DISTINCT = 50    # B: fewer distinct words, per cent of the words
MAX_CAPITALS = 2     # C: more A-Z, per cent of the code points
SALTS = 256          # groups in which the ids of one text are reduced

_SYMBOL = re.compile(rb"[#$%&*|]")  # D
_CAPITALS = bytes(range(65, 91))


def gallop(ids: Sequence[int], x: int, at: int) -> int:
    """First place from ``at`` on whose id is at least ``x``."""
    step, end = 1, at
    while end < len(ids) and ids[end] < x:
        at, end, step = end + 1, end + step, 2 * step
    return bisect_left(ids, x, at, min(end, len(ids)))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Sorted distinct ids of sorted lists: whole runs up to the next list's head at a time."""
    out: list[int] = []
    heads = [[ids[0], k, 0] for k, ids in enumerate(lists) if ids]
    while len(heads) > 1:
        heads.sort()
        x, k, at = heads[0]
        other = heads[1][0]
        end = gallop(lists[k], other, at)
        out.extend(lists[k][at:end])
        if end < len(lists[k]) and lists[k][end] == other:
            end += 1  # the other list still holds it
        if end < len(lists[k]):
            heads[0] = [lists[k][end], k, end]
        else:
            heads.pop(0)
    for x, k, at in heads:
        out.extend(lists[k][at:])
    return out


def difference(ids: Sequence[int], gone: Sequence[int]) -> list[int]:
    """The ids that ``gone`` does not hold; both sorted."""
    out: list[int] = []
    i = j = 0
    while i < len(ids):
        j = gallop(gone, ids[i], j)
        if j == len(gone):
            out.extend(ids[i:])
            break
        end = gallop(ids, gone[j], i)
        out.extend(ids[i:end])
        i = end + (end < len(ids) and ids[end] == gone[j])
    return out


def range_sizes(fails: Sequence[int], n: Sequence[int], good: Sequence[bool],
                toxic: Sequence[bool], filters: int) -> Iterator[tuple]:
    """``before, filter, removed, good_lost, toxic_lost, failed_before, n`` over one id range.

    ``before`` is the bitmap of the filters that came first; entry ``i`` of the
    range stands for ``n[i]`` documents and fails the filters in ``fails[i]``.
    """
    lists = [[i for i, f in enumerate(fails) if f >> k & 1] for k in range(filters)]
    total = sum(n)
    for before in range(1 << filters):
        gone = union([lists[k] for k in range(filters) if before >> k & 1])
        n_gone = sum(n[i] for i in gone)
        for k in range(filters):
            if not before >> k & 1:
                lost = difference(lists[k], gone)
                yield (before, k, sum(n[i] for i in lost), sum(n[i] for i in lost if good[i]),
                       sum(n[i] for i in lost if toxic[i]), n_gone, total)


_SIZES = ("part string, before int, filter int, removed long, good_lost long, toxic_lost long, "
          "failed_before long, n long")


def _sizes(filters: int):
    names = [c.split()[0] for c in _SIZES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one id range of each part that the batch holds
            rows = list(zip(*[b.column(c).to_pylist()
                              for c in ("part", "fails", "n", "good", "toxic")], strict=True))
            out = [(part, *sizes) for part, g in groupby(rows, lambda r: r[0])
                   for sizes in range_sizes(*list(zip(*g))[1:], filters)]
            cols = list(zip(*out)) if out else [[] for _ in names]
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return run


def audit(entries: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every order of ``filters`` removes in each part.

    ``entries``: ``part, id, fails, n, good, toxic``; bit k of ``fails`` stands
    for the k-th filter, ``n`` for the number of such documents.  Returns, per
    part, order and step, ``kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``.
    """
    spark = ready(entries)
    k = len(filters)
    ranges = (entries.repartitionByRange(shuffle_width(spark), "part", F.col("id").asc_nulls_first(),
                                         "fails")
              .sortWithinPartitions("part", F.col("id").asc_nulls_first(), "fails"))
    sums = (ranges.select("part", "fails", "n", "good", "toxic").mapInArrow(_sizes(k), _SIZES)
            .groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in (
                "removed", "good_lost", "toxic_lost", "failed_before", "n")]))
    # 2 ** (k - 1) rows of each part and filter.
    own = Window.partitionBy("part", "filter")
    others = F.lit((1 << k) - 1) - F.expr("shiftleft(1, filter)")
    orders = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]),
                          F.bit_count("before") + 1)  # that begin with just these filters
    sums = (sums.withColumn("failing", F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own))
            .withColumn("unique_fails",
                        F.max(F.when(F.col("before") == others, F.col("removed"))).over(own))
            .withColumn("shapley", F.sum(F.col("removed") * orders).over(own)))
    steps = []
    for order in permutations(filters):
        at = [filters.index(f) for f in order]
        steps += [("".join(order), s + 1, sum(1 << j for j in at[:s]), at[s]) for s in range(k)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    return sums.join(F.broadcast(plan), ["before", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("failed_before") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost",
        "toxic_lost", "shapley")


def text_marks(text: bytes, code_points: int) -> int:
    """Bitmap of the filters A to D that a text fails."""
    words = text.split()  # bytes split at ASCII white space only
    n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
    return ((n < MIN_WORDS) + 2 * (100 * len(set(words)) < MIN_DISTINCT * n)
            + 4 * (100 * capitals > MAX_CAPITALS * code_points) + 8 * bool(_SYMBOL.search(text)))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, points = b.column("text"), pc.utf8_length(b.column("text")).to_pylist()
        texts = texts.cast(pa.binary())
        fails, digests = [], []
        for t, p in zip(texts, points):
            t = t.as_py()
            fails.append(text_marks(t, p))
            digests.append(hashlib.sha256(t).digest()[:16])
        yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array(fails, pa.int32()),
                               pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])


def _first_of_text(marks: DataFrame) -> DataFrame:
    """Adds ``first``: the smallest doc_id of the text; ``marks`` holds no row twice."""
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("first"))
    first = some.withColumn("first", F.min("first").over(Window.partitionBy("digest")))
    return salted.join(first, ["digest", "salt"])


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, fails, n``: how many documents of an id fail which filters."""
    ready(docs)
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
    marks = named.mapInArrow(_marks, "doc_id long, part string, fails int, digest binary")
    once = cut(marks.groupBy("doc_id", "part", "fails", "digest").agg(F.count("*").alias("n")))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return (_first_of_text(once).withColumn("fails", F.col("fails") + F.when(copy, 16).otherwise(0))
            .groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    def any_is_one(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col(name) == 1), F.lit(False)).alias(name)

    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        any_is_one("quality"), any_is_one("toxic"))
    no = F.lit(False)
    entries = failures(docs).join(known, "doc_id", "left").select(
        "part", F.col("doc_id").alias("id"), "fails", "n",
        F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return audit(entries)
