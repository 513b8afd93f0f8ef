"""Exact percentiles with linear interpolation, at any scale.

``percentile(x, p)`` in Spark is exact but keeps a value -> count map per
group in one final task, which breaks once one group holds billions of
distinct values.  This operator selects the two order statistics around
rank ``p * (n - 1)`` without ever gathering a whole group:

1. one aggregate: ``n``, ``min``, ``max`` and a ``percentile_approx``
   bracket ``[lo, hi]`` a few rank-errors around ``p`` (partial
   aggregation, so skew safe);
2. one aggregate counts values below the bracket and inside it; a bracket
   the sketch got wrong is widened to ``[min, max]``;
3. while a bracket still holds more than ``local_limit`` values, a
   1024-bucket histogram over it (a partial aggregate again) narrows it to
   the buckets that hold the wanted ranks; a single-valued bucket settles
   its rank at once, so heavy ties terminate;
4. the wanted ranks are picked with ``row_number`` inside the bracket,
   which now holds at most ``local_limit`` values per group.

Global percentiles share every pass; their bounds are literals, so the
bracket predicate is pushed into the parquet scan.  Grouped percentiles sort
each group of up to ``local_limit`` values and search only the larger ones,
whose state is broadcast, so that no group's values meet in one task.  Interpolation is
``fma(1 - d, lo, d * hi)``, bit for bit DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

ACCURACY = 10_000
LOCAL_LIMIT = 250_000
BUCKETS = 1024


def lerp(a: float | None, z: float | None, d: float) -> float | None:
    if a is None:
        return None
    if d == 0 or z is None:
        return a
    return math.fma(1.0 - d, a, d * z)


class _Target:
    """Search state for one (spec, group)."""

    def __init__(self, n, p, mn, mx, br, plo, phi):
        self.n = n
        pos = p * (n - 1)
        self.k = int(math.floor(pos))
        self.k1 = min(self.k + 1, n - 1)
        self.d = pos - self.k
        self.mn, self.mx = mn, mx
        self.lo = mn if plo == 0.0 else br[0]
        self.hi = mx if phi == 1.0 else br[1]
        self.below = 0
        self.inside = n
        self.a = None
        self.z = None

    def widen_if_missed(self) -> bool:
        if self.below > self.k or self.below + self.inside <= self.k1:
            self.lo, self.hi = self.mn, self.mx
            return True
        return False

    def unresolved(self, limit) -> bool:
        return (self.inside > limit and self.lo < self.hi
                and (self.a is None or self.z is None))

    def narrow(self, hist: list[tuple]) -> None:
        """hist: sorted (bucket, count, min, max) over the bracket."""
        r0, r1 = self.k - self.below, self.k1 - self.below
        cum, lo_b, hi_b = 0, None, None
        for h in hist:
            if lo_b is None and cum + h[1] > r0:
                lo_b = (h, cum)
            if hi_b is None and cum + h[1] > r1:
                hi_b = (h, cum)
            cum += h[1]
        (hl, before_lo), (hh, before_hi) = lo_b, hi_b
        if hl[2] == hl[3]:
            self.a = hl[2]
        if hh[2] == hh[3]:
            self.z = hh[2]
        if self.a is not None and self.z is not None:
            self.inside = 0
            return
        if self.a is not None:      # only the upper rank is open
            first, fb, last, lb = hh, before_hi, hh, before_hi
        elif self.z is not None:    # only the lower rank is open
            first, fb, last, lb = hl, before_lo, hl, before_lo
        else:
            first, fb, last, lb = hl, before_lo, hh, before_hi
        self.lo, self.hi = first[2], last[3]
        self.below += fb
        self.inside = lb + last[1] - fb

    def value(self) -> float | None:
        return lerp(self.a, self.z if self.z is not None else self.a, self.d)


def _clean(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def _levels(p: float) -> tuple[float, float]:
    return max(0.0, p - 3.0 / ACCURACY), min(1.0, p + 3.0 / ACCURACY)


def first_pass_aggs(specs: dict[str, tuple[Column, float]]) -> list[Column]:
    """Pass-1 aggregates (count, min, max, sketch bracket) for each spec.

    They can be computed by ``percentile_scalars`` itself or collected for
    free with ``DataFrame.observe`` while a table is being written.
    """
    aggs = []
    for name, (c, p) in specs.items():
        if not 0.0 <= p <= 1.0:
            raise ValueError("p must be in [0, 1]")
        v = _clean(c)
        plo, phi = _levels(p)
        aggs += [F.count(v).alias(f"_n_{name}"), F.min(v).alias(f"_mn_{name}"),
                 F.max(v).alias(f"_mx_{name}"),
                 F.percentile_approx(v, F.array(F.lit(plo), F.lit(phi)), ACCURACY)
                 .alias(f"_br_{name}")]
    return aggs


def percentile_scalars(df: DataFrame, specs: dict[str, tuple[Column, float]],
                       local_limit: int = LOCAL_LIMIT, first: dict | None = None,
                       extra: dict[str, Column] | None = None) -> dict[str, float | None]:
    """Global exact percentiles of several columns of one table, sharing passes.

    ``specs`` maps a name to ``(column, p)``; nulls and NaNs are ignored.
    ``first`` may hold pass-1 results observed earlier (``first_pass_aggs``);
    they are re-validated against exact counts in pass 2 (an observed metric
    could be counted twice if a stage were re-run) and recomputed if off.
    ``extra`` aggregates ride along in pass 2 and are returned by alias.
    Returns Python floats (``None`` when a column has no values).
    """
    cols = {name: _clean(c) for name, (c, _) in specs.items()}
    if first is None:
        first = df.agg(*first_pass_aggs(specs)).first().asDict()
    out: dict[str, float | None] = {}
    targets = {}
    for name, (_, p) in specs.items():
        n = first[f"_n_{name}"]
        if not n:
            continue
        plo, phi = _levels(p)
        targets[name] = _Target(n, p, first[f"_mn_{name}"], first[f"_mx_{name}"],
                                first[f"_br_{name}"], plo, phi)

    # Pass 2: count below / inside each bracket (+ exact n to check pass 1).
    for attempt in range(3):
        aggs = [c.alias(k) for k, c in (extra or {}).items()] if attempt == 0 else []
        for name, v in cols.items():
            aggs.append(F.count(v).alias(f"_c_{name}"))
            t = targets.get(name)
            if t is not None:
                aggs += [F.count_if(v < F.lit(t.lo)).alias(f"_b_{name}"),
                         F.count_if(v.between(F.lit(t.lo), F.lit(t.hi))).alias(f"_i_{name}")]
        row = df.agg(*aggs).first().asDict()
        if attempt == 0:
            out.update({k: row[k] for k in (extra or {})})
        stale = [name for name in cols
                 if row[f"_c_{name}"] != (first[f"_n_{name}"] or 0)]
        if stale:  # observed pass 1 disagrees with the exact count: redo it
            first = df.agg(*first_pass_aggs(specs)).first().asDict()
            targets = {}
            for name, (_, p) in specs.items():
                if first[f"_n_{name}"]:
                    plo, phi = _levels(p)
                    targets[name] = _Target(first[f"_n_{name}"], p, first[f"_mn_{name}"],
                                            first[f"_mx_{name}"], first[f"_br_{name}"], plo, phi)
            continue
        missed = False
        for name, t in targets.items():
            t.below, t.inside = row[f"_b_{name}"], row[f"_i_{name}"]
            missed |= t.widen_if_missed()
        if not missed:
            break
    else:
        raise RuntimeError("the table changed between the passes of a percentile")
    tagged = [(name, cols[name], t) for name, t in targets.items()]
    for name in specs:
        out.setdefault(name, None)
    if not tagged:
        return out
    _narrow_all(df, [(v, t) for _, v, t in tagged], local_limit)
    pick = []
    for i, (name, v, t) in enumerate(tagged):
        if t.a is not None and t.z is not None or t.lo == t.hi:
            continue
        w = Window.orderBy("_v")
        ranks = [t.k - t.below + 1, t.k1 - t.below + 1]
        pick.append(df.select(v.alias("_v")).where(F.col("_v").between(F.lit(t.lo), F.lit(t.hi)))
                    .withColumn("_rn", F.row_number().over(w))
                    .where(F.col("_rn").isin(*ranks))
                    .select(F.lit(i).alias("_i"), "_rn", "_v"))
    got = {}
    if pick:
        u = pick[0]
        for q in pick[1:]:
            u = u.unionByName(q)
        for r in u.collect():
            got[(r["_i"], r["_rn"])] = r["_v"]
    for i, (name, v, t) in enumerate(tagged):
        if t.lo == t.hi:
            t.a = t.a if t.a is not None else t.lo
            t.z = t.z if t.z is not None else t.lo
        else:
            if t.a is None:
                t.a = got.get((i, t.k - t.below + 1))
            if t.z is None:
                t.z = got.get((i, t.k1 - t.below + 1))
        out[name] = t.value()
    return out


def _narrow_all(df: DataFrame, tagged: list, limit: int) -> None:
    """Pass 3: histogram narrowing of brackets still above ``limit``; one scan
    a round for all of them, until none is left."""
    while True:
        open_ = {i: (v, t) for i, (v, t) in enumerate(tagged) if t.unresolved(limit)}
        if not open_:
            return
        cells = [F.when(v.between(F.lit(t.lo), F.lit(t.hi)), F.struct(
            F.lit(i).alias("i"), _bucket(v, F.lit(t.lo), F.lit(t.hi)).alias("b"), v.alias("v")))
            for i, (v, t) in open_.items()]
        hist = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("e"))
                .groupBy("e.i", "e.b").agg(F.count("*").alias("c"), F.min("e.v").alias("mn"),
                                           F.max("e.v").alias("mx")).collect())  # 1024 a spec
        for i, (_, t) in open_.items():
            before = (t.lo, t.hi, t.a, t.z)
            t.narrow(sorted((h["b"], h["c"], h["mn"], h["mx"]) for h in hist if h["i"] == i))
            if before == (t.lo, t.hi, t.a, t.z):
                raise RuntimeError("a percentile bracket cannot be narrowed further")


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def percentile_exact(df: DataFrame, col: str | Column, p: float,
                     by: Sequence[str] = (), out: str = "pct",
                     local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """Exact linear-interpolated percentile of the non-null values of ``col``.

    Returns ``[*by, out]``.  Without ``by``: exactly one row (null when
    there are no values).  With ``by``: one row per group with values;
    null group keys are skipped, as pandas does.
    """
    spark = df.sparkSession
    v = F.col(col) if isinstance(col, str) else col
    if not by:
        val = percentile_scalars(df, {"x": (v, p)}, local_limit)["x"]
        return spark.range(1).select(F.lit(val).cast("double").alias(out))
    by = list(by)
    vals = (df.select(*by, v.cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    for b in by:
        vals = vals.where(F.col(b).isNotNull())
    schema = T.StructType([f for f in df.select(*by).schema.fields]
                          + [T.StructField(out, T.DoubleType())])
    got = _grouped(vals, by, p, out, local_limit)
    return spark.createDataFrame([], schema).unionByName(got.select(*schema.fieldNames()))


def lerp_col(a: Column, z: Column, d: Column) -> Column:
    """Column form of ``lerp`` (``java.lang.Math.fma``), for grouped results
    that stay distributed."""
    fused = F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"),
                            (F.lit(1.0) - d), a, d * z).cast("double")
    return F.when(d == 0, a).otherwise(fused)


def _grouped(vals: DataFrame, by: list, p: float, out: str, local_limit: int) -> DataFrame:
    """Percentile of each group, for any number of groups of any size.

    Groups of up to ``local_limit`` values are dealt by their key and sorted.
    Larger ones are searched where their values lie: of ``N`` values there are
    at most ``N / local_limit`` such groups, so what is known of them is small
    and goes to the values, which are not shuffled.
    """
    large = cut(vals.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > local_limit))
    if large.isEmpty():
        return _sorted(vals, by, p, out)
    small = vals.join(F.broadcast(large.select(*by)), by, "left_anti")
    return _sorted(small, by, p, out).unionByName(_searched(vals, large, by, p, out, local_limit))


def _sorted(vals: DataFrame, by: list, p: float, out: str) -> DataFrame:
    """Percentile of groups that one task can sort."""
    group = Window.partitionBy(*by)
    pos = F.lit(p) * (F.col("_n") - 1)
    at, rank = F.col("_rn"), F.floor(pos)
    upper = F.least(rank + 1, F.col("_n") - 1)
    return (vals.withColumn("_rn", F.row_number().over(group.orderBy("_v")) - 1)
            .withColumn("_n", F.count("*").over(group))
            .where((at == rank) | (at == upper)).groupBy(*by).agg(
                F.max(F.when(at == rank, F.col("_v"))).alias("_a"),
                F.max(F.when(at == upper, F.col("_v"))).alias("_z"), F.max(pos - rank).alias("_d"))
            .select(*by, lerp_col(F.col("_a"), F.col("_z"), F.col("_d")).alias(out)))


def _searched(vals: DataFrame, large: DataFrame, by: list, p: float, out: str, local_limit: int) -> DataFrame:
    """Percentile of the groups ``large``, a short list.

    The search state -- one row per group and wanted rank, with its bracket
    -- is a DataFrame broadcast to the values.  Each round narrows all
    brackets that hold over ``local_limit`` values by a histogram, in one
    scan, until none does.
    """
    plo, phi = _levels(p)
    pos = F.lit(p) * (F.col("_n") - 1)
    key = [*by, "_rank"]
    state = (vals.join(F.broadcast(large.select(*by)), by).groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
        F.percentile_approx("_v", F.array(F.lit(plo), F.lit(phi)), ACCURACY).alias("_br"))
        .withColumn("_d", pos - F.floor(pos))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(
            F.floor(pos), F.least(F.floor(pos) + 1, F.col("_n") - 1)))))
        .withColumn("_first", F.col("_rank") == F.floor(pos))
        .withColumn("_lo", F.col("_mn") if plo == 0.0 else F.col("_br")[0])
        .withColumn("_hi", F.col("_mx") if phi == 1.0 else F.col("_br")[1]).drop("_br"))
    state = cut(state)
    counts = (vals.join(F.broadcast(state.select(*key, "_lo", "_hi")), by).groupBy(*key).agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
        F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_inside")))
    missed = (F.col("_below") > F.col("_rank")) | (F.col("_below") + F.col("_inside") <= F.col("_rank"))
    state = (counts.join(F.broadcast(state), key).withColumn("_missed", missed)
             .withColumn("_lo", F.when(F.col("_missed"), F.col("_mn")).otherwise(F.col("_lo")))
             .withColumn("_hi", F.when(F.col("_missed"), F.col("_mx")).otherwise(F.col("_hi")))
             .withColumn("_below", F.when(F.col("_missed"), 0).otherwise(F.col("_below")))
             .withColumn("_inside", F.when(F.col("_missed"), F.col("_n")).otherwise(F.col("_inside")))
             .select(*key, "_first", "_d", "_lo", "_hi", "_below", "_inside"))
    state = cut(state)
    wide = (F.col("_inside") > local_limit) & (F.col("_lo") < F.col("_hi"))
    before = None
    while (todo := state.where(wide).agg(F.count("*"), F.sum("_inside"), F.sum(
            F.col("_hi") - F.col("_lo"))).first())[0]:
        if todo == before:
            raise RuntimeError("a percentile bracket cannot be narrowed further")
        before = todo
        wanted = state.where(wide)
        hist = (vals.join(F.broadcast(wanted.select(*key, "_lo", "_hi")), by)
                .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*key, _bucket(F.col("_v"), F.col("_lo"), F.col("_hi")).alias("_b"))
                .agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h")))
        earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("_rank") - F.col("_below")
        hit = (hist.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
               .join(F.broadcast(wanted.drop("_lo", "_hi", "_inside")), key)
               .where((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c")))
               .select(*key, "_first", "_d", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"),
                       (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_inside")))
        state = cut(state.where(~wide).unionByName(hit))
    settled = state.where("_lo = _hi").select(*key, "_first", "_d", F.col("_lo").alias("_x"))
    w = Window.partitionBy(*key).orderBy("_v")
    picked = (vals.join(F.broadcast(state.where("_lo < _hi")), by)
              .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
              .withColumn("_rn", F.row_number().over(w) - 1 + F.col("_below"))
              .where(F.col("_rn") == F.col("_rank")).select(*key, "_first", "_d", F.col("_v").alias("_x")))
    low, high = F.max(F.when(F.col("_first"), F.col("_x"))), F.max(F.when(~F.col("_first"), F.col("_x")))
    return (settled.unionByName(picked).groupBy(*by).agg(
        low.alias("_a"), F.coalesce(high, low).alias("_z"), F.max("_d").alias("_d"))
        .select(*by, lerp_col(F.col("_a"), F.col("_z"), F.col("_d")).alias(out)))


def percentile_value(df: DataFrame, col: str | Column, p: float) -> float | None:
    """Driver-side scalar of a global exact percentile."""
    v = F.col(col) if isinstance(col, str) else col
    return percentile_scalars(df, {"x": (v, p)})["x"]
