"""Small report helpers over *grouped* tables: top-N with an "other" row
(T3/T4/U1), cumulative share (W1), unique short labels (W3) and the
first-in-order arg-max/arg-min (W5).

Their inputs are aggregates (one row per group) or already limited lists,
so an un-partitioned window here runs over a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import ELLIPSIS
from .ordering import with_position

OTHER = "Other"


def money_sum(c: Column | str) -> Column:
    """Exact, order-independent sum of money as a double (0 for no values
    is left to the caller: ``coalesce``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def first_rows(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = (),
               rank: str | None = None) -> DataFrame:
    """The first ``n`` rows in ``order``, of all or of each ``by``; ``rank`` names a rank column.

    Without ``by`` every task sends its first ``n`` rows.  With it, Spark cuts
    each task's rows to ``n`` a group before the shuffle (WindowGroupLimit),
    so a group of any size brings ``n`` rows a task.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    else:
        out = df.orderBy(*order).limit(n)
        if rank:
            out = out.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    if rank:
        out = out.withColumn(rank, F.col("_rn").cast("bigint"))
    return out.drop("_rn")


def top_n_with_other(grouped: DataFrame, key: str, measure: str, n: int,
                     order: list[Column], other_label: str = OTHER) -> DataFrame:
    """Rank groups by ``order``; keep the first ``n`` and, only when more
    groups exist, one ``other`` row holding the rest (T4 + U1).

    Returns ``[rank, key, measure, is_other]``; the other row has rank n+1.
    """
    top = first_rows(grouped, order, n, rank="rank").select(
        "rank", F.col(key), F.col(measure), F.lit(False).alias("is_other"))
    kind = grouped.schema[measure].dataType
    listed = top.agg(F.sum(measure).alias("_top"))
    every = grouped.agg(F.count(F.lit(1)).alias("_k"), F.sum(measure).alias("_all"))
    rest = (attach_one_row(every, listed).where(F.col("_k") > n)
            .select(F.lit(n + 1).cast("bigint").alias("rank"), F.lit(other_label).alias(key),
                    (F.col("_all") - F.col("_top")).cast(kind).alias(measure),
                    F.lit(True).alias("is_other")))
    return top.unionByName(rest)


def cumulative(col: str, order: str = "rank", by: Sequence[str] = ()) -> Column:
    """Running sum in rank order (of a bounded list, or one for each ``by``)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    return F.sum(col).over(w.rowsBetween(Window.unboundedPreceding, 0))


def short_label(name: Column, n: int) -> Column:
    """Cut to n-1 chars (right-trimmed) + '…' when longer than n."""
    t = name.cast("string")
    return F.when(F.length(t) <= n, t).otherwise(
        F.concat(F.regexp_replace(F.substring(t, 1, n - 1), r"\s+$", ""), F.lit(ELLIPSIS)))


def unique_short_labels(df: DataFrame, name: str, order: str, n: int, out: str = "label",
                        by: Sequence[str] = ()) -> DataFrame:
    """Short labels that stay distinct, numbered in list order.

    ``df`` must be a bounded list (a top-N or a handful of categories), or one
    for each ``by``.  A list becomes one array in ``order``; a fold over it
    gives each row the first of ``short``, ``short (2)``, ``short (3)``... that
    is still free.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), short_label(
        F.coalesce(F.col(name).cast("string"), F.lit("None")), n).alias("_s"),
        F.struct(*df.columns).alias("_row"))))

    def free(taken: Column, short: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.when(
            k == 1, short).otherwise(F.concat(short, F.lit(" ("), k.cast("string"), F.lit(")"))))
        return F.filter(tries, lambda t: ~F.array_contains(taken, t))[0]

    labels = F.aggregate("_list", F.array().cast("array<string>"),
                         lambda done, e: F.concat(done, F.array(free(done, e["_s"]))))
    pairs = F.zip_with("_list", labels, lambda e, label: F.struct(
        e["_row"].alias("_row"), label.alias("_label")))
    return (df.groupBy(*by).agg(listed.alias("_list")).select(F.explode(pairs).alias("_e"))
            .select("_e._row.*", F.col("_e._label").alias(out)))


_NUMBERED = r"^(.*) \(\d+\)$"


def _label_family(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule over one family, in rank order."""
    rows = rows.sort_values("_rank", kind="stable")
    taken, nth, labels = set(), {}, []
    for short in rows["_short"]:
        k = nth.get(short, 1)
        while (label := short if k == 1 else f"{short} ({k})") in taken:
            k += 1
        nth[short] = k
        taken.add(label)
        labels.append(label)
    return rows[["_key", "_rank"]].assign(_label=labels)


def short_labels(df: DataFrame, name: str, rank: str, n: int, out: str = "label") -> DataFrame:
    """W3 for a list of any length; ``rank`` is its order, without repeats.

    A label's number is its position among the names that are cut alike, by
    ``with_position``.  Only where a name itself ends like a number, as in
    ``abc (2)``, could that collide; names that differ in such endings form a
    family, and families with such a name go through the sequential rule.
    """
    rows = df.withColumn("_short", short_label(F.coalesce(F.col(name).cast("string"), F.lit("None")), n))
    family = F.col("_short")
    for _ in range(n // 4 + 1):  # 'a (2) (3)' has two endings; an ending has 4 characters at least
        family = F.regexp_replace(family, _NUMBERED, "$1")
    rows = rows.withColumn("_key", family).withColumn("_rank", F.col(rank).cast("long"))
    odd = rows.where(F.col("_short").rlike(_NUMBERED)).select("_key").distinct()
    plain = with_position(rows.join(odd, "_key", "left_anti"), ["_short"], [F.col("_rank")], out="_k")
    plain = plain.withColumn(out, F.when(F.col("_k") == 1, F.col("_short")).otherwise(
        F.concat("_short", F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))))
    told = rows.join(odd, "_key", "left_semi").select("_key", "_rank", "_short").groupBy("_key").applyInPandas(
        _label_family, "_key string, _rank long, _label string")
    odds = rows.join(told, ["_key", "_rank"]).withColumn(out, F.col("_label"))
    return plain.select(*df.columns, out).unionByName(odds.select(*df.columns, out))


def first_flag(order: list[Column]) -> Column:
    """True on the first row in ``order`` (ties -> earliest in order)."""
    return F.row_number().over(Window.orderBy(*order)) == 1


def attach_one_row(base: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row (or empty) aggregate to every row of
    ``base`` as a scalar subquery: evaluated once, no join in the plan.
    An empty aggregate gives nulls."""
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return base.select("*", s.alias("_one")).select("*", "_one.*").drop("_one")
