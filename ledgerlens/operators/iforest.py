"""Isolation Forest as Spark jobs (M1-M8).

Method: Liu, Ting & Zhou, "Isolation Forest", ICDM 2008.  MLlib has no such
estimator, so the forest is grown here:

* **Content keys, not row order.**  Rows with identical features are
  indistinguishable to the model, so the table is first reduced to distinct
  feature vectors with a copy count (a partial aggregate: skew safe).  Copy
  ``j`` of vector ``h`` is identified by ``(h, j)``; all randomness is a hash
  of such keys, so the forest does not depend on partitioning or row order.
* **Two-stage sampling.**  A pool of about ``4 * trees * max_samples`` copies
  is drawn with per-copy Bernoulli trials (a uniform random subset of the
  universe).  Large copy groups are split into chunks and spread over tasks
  first, so a vector repeated on a third of all rows is no hot spot.  Each
  tree then takes the ``max_samples`` pool rows with the smallest
  per-tree hash -- a uniform sample without replacement.
* **Grow** runs in ``groupBy(tree).applyInPandas`` (256 rows per tree),
  **score** in an Arrow UDF with the collected forest
  (at most trees x 511 nodes) shipped to the executors.

Standardising the features (as the reference does) is skipped on purpose:
isolation splits are uniform within each feature's range, so an affine
change of a feature changes nothing but the random stream.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("f_log_value", "f_duration", "f_added", "f_direct")
_EULER = 0.5772156649015329
_CHUNK = 65_536
_MASK53 = (1 << 53) - 1
_ROWS = 16_384  # rows scored together
_CELLS = 1 << 18  # of one table of a tree


def c_factor(n):
    """Average path length of an unsuccessful BST search over ``n`` items."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _unit(*cols: Column) -> Column:
    """Deterministic uniform in [0, 1) from a hash of the given columns."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit(_MASK53)).cast("double")
            / F.lit(float(1 << 53)))


@dataclass
class Forest:
    feature: np.ndarray    # (T, N) int, -1 marks a leaf
    threshold: np.ndarray  # (T, N) float
    left: np.ndarray       # (T, N) int
    right: np.ndarray      # (T, N) int
    leaf_path: np.ndarray  # (T, N) float: depth + c(size) at leaves
    max_samples: int
    max_depth: int

    def _leaves(self, t: int, node: int, box: tuple) -> list[tuple]:
        """``(box, path length)`` of the leaves below a node; a box holds the ranks
        ``[low, high)`` of each feature that lead there."""
        found, stack = [], [(node, box)]
        while stack:
            o, b = stack.pop()
            if self.feature[t, o] < 0:
                found.append((b, self.leaf_path[t, o]))
            else:
                stack += zip((self.left[t, o], self.right[t, o]), self._halves(t, o, b))
        return found

    def _halves(self, t: int, node: int, box: tuple) -> tuple:
        k, cut = int(self.feature[t, node]), int(self._cut_rank[t, node])
        low, high = box[k]
        left, right = (low, max(low, min(high, cut))), (min(high, max(low, cut)), high)
        return box[:k] + (left,) + box[k + 1:], box[:k] + (right,) + box[k + 1:]

    def _tables(self):
        """Each tree as a table of path lengths over its own cuts of the features.

        The rank of a value among all thresholds of its feature decides every
        comparison; a tree's cuts make a grid of ranks, each cell of which lies
        in one leaf.  So a row needs one look-up for each feature and one for
        the cell, not one for each level.  A tree whose grid would have more
        than ``_CELLS`` cells is cut into several: each has 0 outside its own
        subtree, so their sum is the tree's length.  Built once.
        """
        if getattr(self, "_layout", None) is not None:
            return self._layout
        n_features = max(int(self.feature.max()) + 1, 1)
        self._cuts = [np.unique(self.threshold[self.feature == k]) for k in range(n_features)]
        self._cut_rank = np.zeros(self.feature.shape, dtype=np.int64)  # the lowest that goes right
        for k, cuts in enumerate(self._cuts):
            self._cut_rank[self.feature == k] = 1 + np.searchsorted(cuts, self.threshold[self.feature == k])
        whole = tuple((0, len(c) + 1) for c in self._cuts)
        tables = []
        for t in range(self.feature.shape[0]):
            stack = [(0, whole)]
            while stack:
                node, box = stack.pop()
                leaves = self._leaves(t, node, box)
                edges = [sorted({*whole[k], *(e for b, _ in leaves for e in b[k])}) for k in range(n_features)]
                shape = [len(e) - 1 for e in edges]
                if math.prod(shape) > _CELLS and self.feature[t, node] >= 0:
                    stack += zip((self.left[t, node], self.right[t, node]), self._halves(t, node, box))
                    continue
                lengths = [0.0, *sorted({v for _, v in leaves})]
                ids = {v: i for i, v in enumerate(lengths) if i}
                at = [{int(e): i for i, e in enumerate(es)} for es in edges]
                grid = np.zeros(shape, dtype=np.min_scalar_type(len(lengths)))
                for b, v in leaves:
                    grid[tuple(slice(p[low], p[high]) for p, (low, high) in zip(at, b))] = ids[v]
                places = [(k, np.repeat(np.arange(n, dtype=np.int32) * math.prod(shape[k + 1:]), np.diff(edges[k])))
                          for k, n in enumerate(shape) if n > 1]
                tables.append((places, grid.ravel(), np.array(lengths)))
        self._layout = tables
        return tables

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length over the trees, one tree after the other.

        A tree's table and the state of ``_ROWS`` rows stay in the cache; the
        trees' lengths are added in order, so the mean does not depend on how
        rows come in batches.
        """
        tables = self._tables()
        n_trees, total = self.feature.shape[0], np.zeros(len(x))
        for start in range(0, len(x), _ROWS):
            part = x[start:start + _ROWS]
            # Thresholds below a value; nothing is above a threshold where it is no number.
            ranks = [np.where(np.isnan(part[:, k]), 0, np.searchsorted(cuts, part[:, k]))
                     for k, cuts in enumerate(self._cuts)]
            n = len(part)
            cell, place = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
            length, mine = np.empty(n), total[start:start + n]
            for places, grid, lengths in tables:
                cell.fill(0)
                for i, (k, at) in enumerate(places):  # all indices are in range: clip only spares a check
                    np.take(at, ranks[k], out=place if i else cell, mode="clip")
                    if i:
                        cell += place
                np.take(lengths, np.take(grid, cell, mode="clip"), out=length, mode="clip")
                mine += length
        return total / n_trees

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        """``-2^(-E[h(x)] / c(m))``: lower is more unusual."""
        denom = float(c_factor([self.max_samples])[0]) or 1.0
        return -np.power(2.0, -self.path_lengths(x) / denom)


def features(rows: DataFrame, median_duration: float | None) -> DataFrame:
    """M1/M2: the four model features, duration imputed by its median."""
    from .stats import log_value
    return rows.select(
        "*",
        log_value(F.col("value")).alias("f_log_value"),
        F.coalesce(F.col("duration_days").cast("double"),
                   F.lit(median_duration).cast("double")).alias("f_duration"),
        F.coalesce(F.col("added_days").cast("double"), F.lit(0.0)).alias("f_added"),
        F.col("is_direct").cast("double").alias("f_direct"))


def sample_pool(usable: DataFrame, n: int, n_trees: int, m: int, seed: int) -> DataFrame:
    """Stage 1: a uniform pool of about ``4 * n_trees * m`` row copies.

    Copies of one feature vector are told apart by their index ``j``, and
    each copy is kept with its own hashed Bernoulli trial.  Vectors with at
    most one chunk of copies (nearly all) are handled where they are
    aggregated; only heavy vectors are cut into chunks and spread across
    tasks before their trials, so no task runs a third of all trials.
    """
    target = 4 * n_trees * m
    q = min(1.0, target / max(n, 1))
    groups = (usable.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_h", F.xxhash64(*FEATURES, F.lit(seed))))

    def trials(size: Column) -> Column:
        if q >= 1.0:
            return F.sequence(F.lit(0), size - 1)
        return F.filter(F.sequence(F.lit(0), size - 1),
                        lambda j: _unit(F.col("_h"), F.col("_chunk"), j, F.lit(seed), F.lit(1))
                        < F.lit(q))

    light = (groups.where(F.col("_c") <= _CHUNK)
             .withColumn("_chunk", F.lit(0))
             .select(*FEATURES, "_h", "_chunk", F.explode(trials(F.col("_c").cast("int"))).alias("_j")))
    heavy = (groups.where(F.col("_c") > _CHUNK)
             .withColumn("_chunk", F.explode(F.sequence(
                 F.lit(0), ((F.col("_c") - 1) / F.lit(_CHUNK)).cast("int"))))
             .withColumn("_size", F.least(F.lit(_CHUNK).cast("bigint"),
                                          F.col("_c") - F.col("_chunk") * F.lit(_CHUNK)).cast("int"))
             .repartition("_h", "_chunk")
             .select(*FEATURES, "_h", "_chunk", F.explode(trials(F.col("_size"))).alias("_j")))
    return (light.unionByName(heavy)
            .withColumn("_key", F.xxhash64("_h", "_chunk", "_j")))


def sample_trees(pool: DataFrame, pool_size: int, n_trees: int, m: int, seed: int,
                 prefilter: bool = True) -> DataFrame:
    """Stage 2: per tree, the ``m`` pool rows with the smallest tree hash."""
    p2 = min(1.0, 4.0 * m / max(pool_size, 1)) if prefilter else 1.0
    u = lambda t: _unit(F.col("_key"), t, F.lit(seed), F.lit(2))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < F.lit(p2))
    w = Window.partitionBy("_tree").orderBy("_u", "_key")
    return (pool.select(*FEATURES, "_key", F.explode(trees).alias("_tree"))
            .withColumn("_u", u(F.col("_tree")))
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= m)
            .drop("_rn"))


NODE_SCHEMA = ("_tree int, node int, feature int, threshold double, left int, right int, "
               "leaf_path double, size int")


def _grow_one(pdf: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf["_tree"].iloc[0])
    pdf = pdf.sort_values(["_u", "_key"], kind="mergesort")
    x = pdf[list(FEATURES)].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    nodes = []  # feature, threshold, left, right, leaf_path, size

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        leaf = (-1, 0.0, -1, -1, depth + float(c_factor([len(idx)])[0]), len(idx))
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = leaf
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            nodes[me] = leaf
            return me
        f = int(candidates[rng.integers(candidates.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        if thr >= hi[f]:
            thr = float(lo[f])
        go = sub[:, f] <= thr
        left = build(idx[go], depth + 1)
        right = build(idx[~go], depth + 1)
        nodes[me] = (f, thr, left, right, 0.0, len(idx))
        return me

    build(np.arange(len(x)), 0)
    arr = np.array(nodes, dtype=object)
    return pd.DataFrame({
        "_tree": tree, "node": np.arange(len(nodes), dtype=np.int32),
        "feature": arr[:, 0].astype(np.int32), "threshold": arr[:, 1].astype(float),
        "left": arr[:, 2].astype(np.int32), "right": arr[:, 3].astype(np.int32),
        "leaf_path": arr[:, 4].astype(float), "size": arr[:, 5].astype(np.int32)})


def fit(usable: DataFrame, n: int, n_trees: int, max_samples: int, seed: int,
        out_path: str | None = None) -> Forest:
    """M6: grow the forest on Spark; returns the (bounded) collected forest.

    With ``out_path`` the node table is written there first (part of the
    snapshot, so later jobs can score without refitting) and read back.
    """
    m = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(m, 2))))
    target = 4 * n_trees * m
    pool_size = n if target >= n else target  # exact when every copy is kept
    pool = sample_pool(usable, n, n_trees, m, seed)
    grow = lambda pdf: _grow_one(pdf, seed, max_depth)
    cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def grown_nodes(prefilter: bool) -> pd.DataFrame:
        sampled = sample_trees(pool, pool_size, n_trees, m, seed, prefilter=prefilter)
        grown = sampled.groupBy("_tree").applyInPandas(grow, NODE_SCHEMA)
        if out_path:
            (grown.withColumn("max_samples", F.lit(m)).withColumn("max_depth", F.lit(max_depth))
             .write.mode("overwrite").parquet(out_path))
            grown = usable.sparkSession.read.parquet(out_path)
        return grown.select(*cols).toPandas()  # <= n_trees * (2^(max_depth+1) - 1) rows

    nodes = grown_nodes(prefilter=True)
    roots = nodes[nodes["node"] == 0]
    if len(roots) < n_trees or int(roots["size"].min()) < min(m, n):
        # a tree missed its quota under the pre-filter: take every pool row
        nodes = grown_nodes(prefilter=False)
    return forest_from_nodes(nodes, n_trees, m, max_depth)


def load_forest(spark, path: str) -> Forest:
    """Read a forest written by ``fit(out_path=...)``."""
    t = spark.read.parquet(path)
    meta = t.select("max_samples", "max_depth").first()
    nodes = t.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]).toPandas()
    n_trees = int(nodes["_tree"].max()) + 1
    return forest_from_nodes(nodes, n_trees, int(meta[0]), int(meta[1]))


def forest_from_nodes(nodes: pd.DataFrame, n_trees: int, m: int, max_depth: int) -> Forest:
    width = int(nodes["node"].max()) + 1
    shape = (n_trees, width)
    feat = np.full(shape, -1, dtype=np.int64)
    thr = np.zeros(shape)
    left = np.zeros(shape, dtype=np.int64)
    right = np.zeros(shape, dtype=np.int64)
    leaf = np.zeros(shape)
    t, k = nodes["_tree"].to_numpy(), nodes["node"].to_numpy()
    feat[t, k] = nodes["feature"].to_numpy()
    thr[t, k] = nodes["threshold"].to_numpy()
    left[t, k] = nodes["left"].to_numpy()
    right[t, k] = nodes["right"].to_numpy()
    leaf[t, k] = nodes["leaf_path"].to_numpy()
    return Forest(feat, thr, left, right, leaf, m, max_depth)


def score_column(forest: Forest, spark) -> callable:
    """M7: an Arrow UDF scoring the four feature columns with the forest."""
    bc = spark.sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def score(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        x = np.column_stack([v.to_numpy(zero_copy_only=False) for v in (a, b, c, d)])
        return pa.array(bc.value.raw_score(x))

    return score
