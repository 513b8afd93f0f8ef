"""Views over the snapshot.

A view only chooses rows; it never recomputes a threshold.  All predicates
are ANDed into one ``filter`` on the snapshot, so Catalyst pushes the
column predicates into the parquet scan and prunes ``sign_year``
partitions (null years stay in, as the reference keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_all_words, normalize
from ..operators.distinct_sets import bitmaps, number_rows, repeated, sizes
from ..operators.ordering import with_position
from ..operators.report import attach_one_row
from ..session import stored


@dataclass(frozen=True)
class ViewSpec:
    """one composed view (empty selections mean 'all')."""

    query: str = ""
    modalities: tuple = ()
    entities: tuple = ()
    years: tuple | None = None  # (from, to), inclusive
    bands: tuple = ()           # band labels
    priority_only: bool = False


def view_predicate(spec: ViewSpec, year_filter_enabled: bool = True) -> Column | None:
    preds = []
    text = contains_all_words(F.col("search_text"), spec.query)          # F1
    if text is not None:
        preds.append(text)
    if spec.modalities:                                                   # F2
        preds.append(F.col("modality").isin(list(spec.modalities)))
    if spec.entities:                                                     # F3
        preds.append(F.col("entity").isin(list(spec.entities)))
    if spec.years is not None and year_filter_enabled:                   # F4
        a, b = spec.years
        preds.append(F.col("sign_year").isNull() | F.col("sign_year").between(a, b))
    if spec.bands:                                                        # F5
        preds.append(F.col("value_band_label").isin(list(spec.bands)))
    if spec.priority_only:                                                # F6
        preds.append(F.col("rule_priority"))
    return reduce(lambda x, y: x & y, preds) if preds else None


def apply_view(rows: DataFrame, spec: ViewSpec, year_filter_enabled: bool = True) -> DataFrame:
    p = view_predicate(spec, year_filter_enabled)
    return rows if p is None else rows.where(p)


def text_search(rows: DataFrame, query: str) -> DataFrame:
    """F1 alone: rows whose search text holds every query word."""
    return apply_view(rows, ViewSpec(query=query))


# --------------------------------------------------------------------------
# filter options
# --------------------------------------------------------------------------
def modality_options(rows: DataFrame) -> DataFrame:
    return (rows.where(F.col("modality").isNotNull()).select("modality").distinct()
            .orderBy("modality"))


def entity_options(rows: DataFrame) -> DataFrame:
    """Entities by row count, largest first (name breaks ties)."""
    return (rows.where(F.col("entity").isNotNull()).groupBy("entity")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), "entity"))


def year_range(rows: DataFrame) -> DataFrame:
    """First and last signing year; (0, 0) when no row has a year."""
    return rows.agg(F.coalesce(F.min("sign_year"), F.lit(0)).cast("bigint").alias("year_min"),
                    F.coalesce(F.max("sign_year"), F.lit(0)).cast("bigint").alias("year_max"))


def filter_options(rows: DataFrame) -> DataFrame:
    """F9 as one long table: (kind, value, n_rows, rank).

    Modalities are ranked by name, entities by row count (name breaks ties),
    by ``with_position``, so no task ranks all entities.  The years' ``n_rows``
    counts the rows with a signing year.
    """
    def options(col: str) -> DataFrame:
        return (rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
                .agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit(col).alias("kind"), "value", "n_rows"))

    years = rows.agg(*[F.coalesce(f("sign_year"), F.lit(0)).cast("string").alias(name)
                       for name, f in (("year_min", F.min), ("year_max", F.max))],
                     F.count("sign_year").alias("n_rows"))
    ends = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value"), "n_rows")
                     for c in ("year_min", "year_max")])
    every = (options("modality").unionByName(options("entity"))
             .unionByName(years.select(F.inline(ends))))
    by_count = F.when(F.col("kind") == "entity", -F.col("n_rows")).otherwise(F.lit(0))
    return with_position(every, ["kind"], [by_count, F.col("value")], out="rank")


# --------------------------------------------------------------------------
# F8: saved views, resolved in batch
# --------------------------------------------------------------------------
LIST_KEYS = {"modality": "modality", "entity": "entity", "band": "value_band_label"}


def resolve_saved_views(saved: DataFrame, rows: DataFrame) -> DataFrame:
    """Resolve stored view parameters against the current data.

    ``saved`` is a long table ``(view_id, key, value)`` with keys
    ``q``, ``modality``, ``entity``, ``band``, ``from``, ``to``, ``priority``.
    Options no longer in the data are dropped (left-semi join on the
    distinct options); years are clamped to the data's range, and a
    reversed or unparseable range falls back to the full range.  Of a year
    key stored twice for a view the greatest text counts.  Output: one row
    per (view_id, key, value) that survives, years included.
    """
    opts = None
    for key, col in LIST_KEYS.items():
        o = rows.where(F.col(col).isNotNull()).select(
            F.lit(key).alias("key"), F.col(col).alias("value")).distinct()
        opts = o if opts is None else opts.unionByName(o)
    lists = (saved.where(F.col("key").isin(list(LIST_KEYS)))
             .join(opts, ["key", "value"], "left_semi").select("view_id", "key", "value"))
    other = saved.where(F.col("key").isin("q", "priority")).select("view_id", "key", "value")
    yr = year_range(rows)
    ends = saved.groupBy("view_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_{k}") for k in ("from", "to")])
    y = (attach_one_row(ends, yr)
         .withColumn("_a", F.expr("try_cast(_from as bigint)"))
         .withColumn("_b", F.expr("try_cast(_to as bigint)")))
    a = F.least(F.greatest(F.coalesce("_a", "year_min"), F.col("year_min")), F.col("year_max"))
    b = F.least(F.greatest(F.coalesce("_b", "year_max"), F.col("year_min")), F.col("year_max"))
    bad = ((F.col("_from").isNotNull() & F.col("_a").isNull())
           | (F.col("_to").isNotNull() & F.col("_b").isNull()) | (a > b))
    y = y.select("view_id",
                 F.when(bad, F.col("year_min")).otherwise(a).alias("from"),
                 F.when(bad, F.col("year_max")).otherwise(b).alias("to"),
                 (F.col("year_max") > F.col("year_min")).alias("_has_range"))
    years = (y.where("_has_range")
             .select("view_id", F.lit("from").alias("key"), F.col("from").cast("string").alias("value"))
             .unionByName(y.where("_has_range").select(
                 "view_id", F.lit("to").alias("key"), F.col("to").cast("string").alias("value"))))
    return lists.unionByName(other).unionByName(years)


#: What a row is matched by, besides the words found in its search text.
CELL = ("entity", "modality", "value_band_label", "sign_year", "rule_priority")


def saved_rows(spark: SparkSession, specs: dict[int, ViewSpec]) -> DataFrame:
    """Views as stored parameters: ``(view_id, key, value)``."""
    stored = [(v, "spec", "") for v in specs]  # a view without choices is one as well
    for v, s in specs.items():
        lists = (("modality", s.modalities), ("entity", s.entities), ("band", s.bands))
        stored += [(v, key, x) for key, chosen in lists for x in chosen]
        stored += [(v, "from", str(s.years[0])), (v, "to", str(s.years[1]))] if s.years else []
        stored += [(v, "q", s.query)] * bool(s.query) + [(v, "priority", "1")] * s.priority_only
    return spark.createDataFrame(stored, "view_id int, key string, value string")


def view_table(resolved: DataFrame, saved: DataFrame) -> DataFrame:
    """One row of predicates per saved view, in a table of any size.

    ``view_id, entities, modalities, bands, year_from, year_to, priority,
    words``; an empty list or a null year chooses all.  A view of which
    nothing is left is kept and shows all rows.
    """
    key, value = F.col("key"), F.col("value")

    def chosen(name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(key == name, value)))

    def year(name: str) -> Column:
        return F.max(F.when(key == name, F.expr("try_cast(value as int)")))

    words = F.split(normalize(value), r"[\s\x1c-\x1f]+")  # white space of Python's split
    per = resolved.withColumn("_words", F.when(key == "q", words)).groupBy("view_id").agg(
        chosen("entity").alias("entities"), chosen("modality").alias("modalities"),
        chosen("band").alias("bands"), year("from").alias("year_from"), year("to").alias("year_to"),
        F.bool_or((key == "priority") & (value == "1")).alias("priority"),
        F.array_remove(F.array_distinct(F.flatten(F.collect_list("_words"))), "").alias("words"))
    none = F.array().cast("array<string>")
    return saved.select("view_id").distinct().join(per, "view_id", "left").select(
        "view_id", *[F.coalesce(c, none).alias(c) for c in ("entities", "modalities", "bands")],
        F.when(F.col("year_to").isNotNull(), F.col("year_from")).alias("year_from"),
        F.when(F.col("year_from").isNotNull(), F.col("year_to")).alias("year_to"),
        F.coalesce("priority", F.lit(False)).alias("priority"),
        F.coalesce("words", none).alias("words"))


def _with_cell(rows: DataFrame, views: DataFrame) -> DataFrame:
    """Adds ``_cell``: what the views can tell of a row, with the views' words that it holds.

    The words of all views, a bounded list of parameters, reach the rows as
    one scalar.
    """
    words = views.select(F.explode("words").alias("w")).agg(
        F.array_sort(F.collect_set("w")).alias("_words"))
    held = F.filter("_words", lambda w: F.contains(F.col("search_text"), w))
    return (attach_one_row(rows, words)
            .withColumn("_cell", F.struct(*CELL, F.coalesce(held, F.array().cast("array<string>")).alias("words")))
            .drop("_words"))


def _options(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("option")))


def _anchors(views: DataFrame) -> DataFrame:
    """Each view once for each option of its narrowest clause; views without clauses have the kind ``any``."""
    years = F.concat(F.transform(F.sequence("year_from", "year_to"), lambda y: y.cast("string")),
                     F.array(F.lit("")))  # a row without year is in every range
    longest = F.array_sort("words", lambda a, b: F.length(b) - F.length(a))
    some = lambda c: F.size(c) > 0
    options = (F.when(some("entities"), _options("entity", F.col("entities")))
               .when(some("words"), _options("word", F.slice(longest, 1, 1)))
               .when(some("modalities"), _options("modality", F.col("modalities")))
               .when(some("bands"), _options("band", F.col("bands")))
               .when(F.col("year_from").isNotNull(), _options("year", years))
               .when(F.col("priority"), _options("priority", F.array(F.lit("true"))))
               .otherwise(_options("any", F.array(F.lit("")))))
    return views.select("*", F.inline(options))


def _is_free() -> Column:
    """Whether a view has no clause."""
    return ((F.size("entities") + F.size("modalities") + F.size("bands") + F.size("words") == 0)
            & F.col("year_from").isNull() & ~F.col("priority"))


def matching_views(cells: DataFrame, views: DataFrame, free: bool = False) -> DataFrame:
    """``cells`` joined to the views that choose them, as data.

    A view's predicates are rows: the options of its narrowest clause meet
    the cells by an equal join, and the other clauses are checked on the pair
    that comes out.  Views without clauses are in the result where ``free``.
    The views, a list of parameters, go to the cells, which are not shuffled.
    """
    c = lambda name: F.col(f"_cell.{name}")
    own = F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("option")) for kind, value in (
        ("entity", c("entity")), ("modality", c("modality")), ("band", c("value_band_label")),
        ("year", F.coalesce(c("sign_year").cast("string"), F.lit(""))),
        ("priority", F.when(c("rule_priority"), "true")), *([("any", F.lit(""))] if free else []))])
    keyed = cells.select("*", F.inline(F.concat(own, _options("word", c("words"))))).where("option IS NOT NULL")

    def fits(chosen: str, value: Column) -> Column:
        return (F.size(chosen) == 0) | F.coalesce(F.array_contains(F.col(chosen), value), F.lit(False))

    year = c("sign_year")
    return (keyed.join(F.broadcast(_anchors(views)), ["kind", "option"]).where(
        fits("entities", c("entity")) & fits("modalities", c("modality"))
        & fits("bands", c("value_band_label")) & (~F.col("priority") | c("rule_priority"))
        & (F.col("year_from").isNull() | year.isNull() | year.between(F.col("year_from"), F.col("year_to")))
        & (F.size(F.array_except(F.col("words"), c("words"))) == 0))
        .select(*cells.columns, "view_id"))


def view_members(rows: DataFrame, views: DataFrame) -> DataFrame:
    """The rows of every view, tagged with ``view_id``: once for each view that shows them.

    Rows meet the views where they are read: cells, which hold an entity, are
    nearly as many as rows, so telling them apart first would shuffle all.
    """
    return matching_views(_with_cell(rows, views), views, free=True).drop("_cell")


def facts_by_view(rows: DataFrame, views: DataFrame) -> DataFrame:
    """Headline numbers of all ``views`` (a ``view_table``) from one scan.

    Rows that no view can tell apart are added up first (map-side), so only
    cells meet the views; what a view shows is the sum of its cells.  Views
    without clauses share the sum of all.
    """
    money = F.col("value").cast("decimal(18,2)")
    facts = {"n_rows": F.count(F.lit(1)), "_total": F.sum(money).cast("decimal(28,2)"),
             "n_values": F.count("value"), "n_priority": F.count_if(F.col("rule_priority")),
             "n_critical": F.count_if(F.col("signals") == 3), "n_direct": F.sum("is_direct").cast("bigint"),
             "n_sme": F.count_if(F.col("is_sme"))}
    cells = _with_cell(rows, views).groupBy("_cell").agg(*[x.alias(name) for name, x in facts.items()])

    def added(name: str) -> Column:
        return F.sum(name).cast(cells.schema[name].dataType).alias(name)

    per = matching_views(cells, views).groupBy("view_id").agg(*[added(name) for name in facts])
    every = attach_one_row(views.where(_is_free()).select("view_id"), cells.agg(*[added(n) for n in facts]))
    shown = views.select("view_id").join(per.unionByName(every), "view_id", "left")
    zero = {name: 0 for name in facts if name != "_total"}
    return shown.fillna(zero).select(
        "view_id", "n_rows", F.coalesce(F.col("_total").cast("double"), F.lit(0.0)).alias("total_value"),
        "n_values", "n_priority", "n_critical", "n_direct", "n_sme")


def contracts_by_view(rows: DataFrame, views: DataFrame, numbers: DataFrame) -> DataFrame:
    """A1, A2 of every view: ``view_id, n_rows, n_contracts, n_repeated``.

    ``numbers`` are the universe's contracts (``distinct_sets.dense_numbers``).
    Views without clauses share the set of all.
    """
    needed = rows.select("contract_id", "search_text", *CELL)
    shown = stored(view_members(needed, views).select("view_id", "contract_id"))
    base = shown.groupBy("view_id").agg(F.count("*").alias("n_rows"))
    numbered = stored(number_rows(shown, numbers, "contract_id").select("view_id", "number"))
    parts = (base, sizes(bitmaps(numbered, ["view_id"]), ["view_id"], "n_contracts"),
             repeated(numbered, ["view_id"]))
    out = views.select("view_id")
    for part in parts:
        out = out.join(part, "view_id", "left")
    return out.fillna(0)
