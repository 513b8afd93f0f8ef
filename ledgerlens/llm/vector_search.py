"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets one long hash string per tree; a bit says on which side of
a hyperplane it lies.  The hyperplanes stand halfway between two sampled
vectors, and every tree takes its own bits from one pool of them.  A tree is
the sorted array of its strings.  A query descends in every tree to the
longest prefix it shares, then all trees ascend together, a turn of trees at a
time by one bit, until their prefix ranges hold enough different candidates;
those are scored exactly.  Nearness is the inner product: vectors are lifted by
one coordinate that brings all to one length, so that the nearest by angle
are the nearest by inner product.

The index is dealt by a hash of vec_id into blocks of about ``block_rows``
vectors, each with a forest of its own; the queries, in blocks too, visit
every block, and the best of all blocks are merged.  Enough is ``SHARE`` of
a block's different vectors, ``LEAST`` at least: vectors without structure
need a fixed share for a fixed recall, whatever the index (README).
Hyperplanes come from at most ``SAMPLE`` different vectors of smallest hash;
every vector is indexed.

Vectors that are null, empty, all zero, or hold a null or non-finite
component take no part, neither do those of another than the commonest
length (the longer at a tie).  Of rows with one vec_id the smallest vector
counts; null vec_ids take no part.  Equal scores go to the smaller vec_id.  An empty table gives an empty result.
Columns other than those named are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready

TREES = 512
BITS = 16
PLANES = 1024  # hyperplanes that the trees' bits are taken from
SHARE = 0.3    # of a block's different vectors that the trees' ranges hold at least
LEAST = 800    # and different vectors at least
TURNS = 8      # in which the trees ascend by one bit; after each, queries with enough stop
BLOCK_ROWS = 16384
QUERY_ROWS = 4096
SAMPLE = 4096
NEAREST = 20


def usable(v: Column) -> Column:
    """Whether a vector can take part."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Adds the coordinate that brings every row to length ``longest``."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))
    return np.column_stack([x, rest])


@dataclass(frozen=True)
class Planes:
    normal: np.ndarray  # (dimensions, planes)
    middle: np.ndarray  # (planes,)
    pick: np.ndarray    # (trees, bits): the planes of each tree's bits


def hyperplanes(sample: np.ndarray, trees: int = TREES, bits: int = BITS, planes: int = PLANES,
                seed: int = 11) -> Planes:
    """Planes halfway between two vectors of the sample, and each tree's choice of them."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(sample), (2, planes))
    normal = sample[a] - sample[b]
    same = ~normal.any(1)  # a vector paired with itself or a copy
    normal[same] = rng.standard_normal((int(same.sum()), sample.shape[1]))
    middle = np.where(same, 0.0, (normal * (sample[a] + sample[b])).sum(1) / 2)
    pick = np.stack([rng.permutation(planes)[:bits] for _ in range(trees)])
    return Planes(np.ascontiguousarray(normal.T), middle, pick)


def hash_strings(x: np.ndarray, planes: Planes) -> np.ndarray:
    """(trees, rows): the strings as numbers, their first bit highest."""
    side = np.ascontiguousarray((x @ planes.normal > planes.middle).T)
    out = np.empty((len(planes.pick), len(x)), np.int32)
    for t, pick in enumerate(planes.pick):
        code = np.zeros(len(x), np.int64)
        for part in np.packbits(side[pick], axis=0):  # eight bits at a time, the last filled up
            code = code << 8 | part
        out[t] = code >> (-len(pick) % 8)
    return out  # of at most 31 bits


def _mark(mark: np.ndarray, rows: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Marks, for each of ``rows``, what stands in its range of the sorted array."""
    n = high - low
    total = int(n.sum())
    if total:
        at = np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)
        mark[np.repeat(rows, n), order[at]] = True


def candidates(x: np.ndarray, q: np.ndarray, planes: Planes, least: int,
               turns: int = TURNS) -> np.ndarray:
    """(queries, rows): whether the forest proposes a row of ``x`` for a row of ``q`` (both lifted).

    ``x`` holds no vector twice.  The trees ascend by one bit in ``turns``; a
    query stops after the first turn with which its ranges hold ``least``
    different rows, or at the root.
    """
    codes, mine = hash_strings(x, planes), hash_strings(q, planes)
    trees, bits = planes.pick.shape
    orders = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
    low = np.zeros((trees, len(q)), np.int32)
    high = np.zeros_like(low)
    mark = np.zeros((len(q), len(x)), bool)
    active = np.arange(len(q))
    for depth, turn in itertools.product(range(bits, -1, -1), range(turns)):
        for t in range(turn, trees, turns):
            held = np.bincount(codes[t] >> (bits - depth), minlength=1 << depth)
            start = np.concatenate([[0], np.cumsum(held)])
            prefix = mine[t, active] >> (bits - depth)
            lo, hi = start[prefix], start[prefix + 1]
            if depth == bits:
                _mark(mark, active, orders[t], lo, hi)
            else:  # what the shorter prefix adds on either side
                _mark(mark, active, orders[t], lo, low[t, active].astype(np.int64))
                _mark(mark, active, orders[t], high[t, active].astype(np.int64), hi)
            low[t, active], high[t, active] = lo, hi
        active = active[np.count_nonzero(mark[active], axis=1) < least]
        if not len(active):
            break
    return mark


def block_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray,
                 planes: Planes, longest: float, k: int, share: float, least: int) -> pd.DataFrame:
    """The best ``k`` proposed rows of one block for each query.

    Different vectors are indexed and scored; their smallest ids, ``k + 1`` as
    the query's own may be among them, are attached to the best.
    """
    found = []
    lifted_q = np.column_stack([q, np.zeros(len(q))])
    x = x + 0.0  # -0.0 equals 0.0
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    by = np.lexsort((ids, group))
    start = np.searchsorted(group[by], np.arange(len(first) + 1))
    kinds = x[first]
    enough = max(least, math.ceil(share * len(kinds)))
    for i, proposed in enumerate(candidates(lift(kinds, longest), lifted_q, planes, enough)):
        at = np.flatnonzero(proposed)
        near = kinds[at] @ q[i]
        if len(at) > k + 1:  # everything that rounding could bring among the best k, besides its own
            edge = np.partition(near, -k - 1)[-k - 1]
            at = at[near >= edge - 1e-9 * max(1.0, longest * longest)]
        at = np.concatenate([np.empty(0, np.int64), *[
            by[start[g]:min(start[g] + k + 1, start[g + 1])] for g in at]])
        at = at[ids[at] != query_ids[i]]
        exact = (x[at] * q[i]).sum(1)  # equal vectors get equal scores
        best = np.lexsort((ids[at], -exact))[:k]
        found.append((np.full(len(best), query_ids[i]), ids[at][best], exact[best]))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, trees: int = TREES,
           bits: int = BITS, share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row."""
    spark = ready(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(
        usable(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    if not lengths:
        return empty
    rows = cut(rows.filter(F.size("v") == lengths["d"]).groupBy("vec_id").agg(F.min("v").alias("v")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, n_queries, longest = rows.agg(
        F.count("*"), F.count(F.when(is_query, 1)), F.sqrt(F.max(squares))).first()
    if not n_queries:
        return empty
    # Different vectors of smallest hash: copies of a hot vector would spoil the planes.
    mark = F.xxhash64(F.lit("planes"), "v")
    some = min(1.0, 16 * sample / n)
    chosen = (rows.where(F.pmod(mark, F.lit(1 << 20)) < some * (1 << 20)).select("v", mark.alias("h"))
              .distinct().orderBy("h", "v").limit(sample).collect())
    chosen = chosen or rows.limit(1).collect()
    planes = hyperplanes(lift(np.array([r["v"] for r in chosen]), longest), trees, bits)
    blocks, q_blocks = -(-n // block_rows), -(-n_queries // query_rows)
    sent = spark.sparkContext.broadcast(planes)  # PLANES hyperplanes

    def one(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return block_search(index["vec_id"].to_numpy(), np.stack(index["v"].to_numpy()),
                            queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()),
                            sent.value, longest, k, share, least)

    def dealt(salt: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    index = rows.withColumn("block", dealt("block", blocks)).withColumn("q_block", every(q_blocks))
    queries = rows.filter(is_query).withColumn("q_block", dealt("q", q_blocks)).withColumn(
        "block", every(blocks))
    key = ["block", "q_block"]
    found = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(
        one, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
