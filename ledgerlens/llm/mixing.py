"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; within a source each document
has the same expected number of copies, ``target / size of the source``.
The prefix sum of the expected copies, shifted by one random offset of the
source, crosses an integer boundary once for each copy that is emitted.
Documents stand in order of falling size, so the words taken differ from
the target by less than the source's largest document.

Null or empty texts have size 0 and take 0 words; null sources form one
source, last in order; a source without words has target 0.  Repeated rows
are separate documents.  Texts of any length are counted whole.  An empty
table gives an empty result.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, ready, with_position, word_count

WEIGHTS = (3, 1, 2)  # by position of the source in code point order, repeating
SHARE = 1.5          # words of the mix against all words
MAX_REPEAT = 2       # a target stops at this many times its source's size
SEED = "mix"


def _source_key() -> list[Column]:
    return [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src")]


def _offset(seed: str) -> Column:
    """The source's random offset in [0, 1)."""
    named = F.when(F.col("_none"), "n").otherwise(F.concat(F.lit("s"), "_src"))
    first = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 8)
    return F.conv(first, 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``_none, _src, source_size, target`` of each source of ``(_none, _src, size)``.

    Targets share ``share`` of all words by weight; what exceeds the cap of a
    source is shared again among the others, until no target is above its cap.
    """
    sizes = sized.groupBy("_none", "_src").agg(F.sum("size").alias("source_size"))
    ranked = with_position(sizes, [], [F.col("_none"), F.col("_src")])
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    src = cut(ranked.withColumn(
        "weight", F.element_at(kinds, ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))))
    total, all_w = src.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level, capped = (goal / all_w if all_w else 0.0), 0
    while True:  # the capped set only grows
        over = F.lit(level) * F.col("weight") > F.col("cap")
        n, cap_sum, left = src.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (goal - cap_sum) / left, n
    return src.select("_none", "_src", "source_size",
                      F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
             max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``."""
    ready(docs)
    sized = docs.select("doc_id", *_source_key(), word_count(F.col("text")).alias("size"))
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    placed = with_position(sized, ["_none", "_src"], order)
    targets = source_targets(placed, weights, share, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = lambda k: F.floor(rate * k + F.col("_offset"))
    copies = F.least(at(F.col("pos")) - at(F.col("pos") - 1), F.lit(max_repeat))
    return (placed.join(targets, ["_none", "_src"])
            .withColumn("_offset", _offset(seed))
            .withColumn("copies", copies.cast("int"))
            .select("doc_id", F.when(~F.col("_none"), F.col("_src")).alias("source"), "size",
                    "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan says.

    Rows that agree in doc_id, source and size share out their copies, the
    most copies first, in the order of a digest of their text and then of
    their other columns, so reruns agree.  Such rows are numbered by ranges
    (``with_position``): however many there are, they spread over tasks.
    """
    plan = mix_plan(docs, **kw)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), *_source_key(),
           F.col("size").alias("_size")]
    same = ["_id", "_none", "_src", "_size"]
    counts = cut(plan.groupBy(*key, "copies").agg(F.count("*").alias("_n")))
    upto = Window.partitionBy(*same).orderBy(F.desc("copies"))  # one row for each number of copies
    owed = (counts.withColumn("_upto", F.sum("_n").over(upto)).groupBy(*same).agg(
        F.sum("_n").alias("_m"), F.sort_array(F.collect_list(F.struct("_upto", "copies"))).alias("_owed"))
        .where(F.exists("_owed", lambda e: e["copies"] > 0)))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source",
                       word_count(F.col("text")).alias("size")).select("_row", *key)
    # Most keys have one row, whose copies are known; the rows of the others are numbered.
    copied = rows.join(owed.where("_m = 1"), same).select("_row", F.col("_owed")[0]["copies"].alias("_copies"))
    if owed.where("_m > 1").limit(1).count():
        text, rest = F.md5(F.coalesce("_row.text", F.lit(""))), F.xxhash64(F.to_json("_row"))
        nth = with_position(rows.join(owed.where("_m > 1"), same), same, [text, rest], out="_nth")
        mine = F.filter("_owed", lambda e: F.col("_nth") <= e["_upto"])  # the first of them
        copied = copied.unionByName(nth.select("_row", F.get(mine, F.lit(0))["copies"].alias("_copies")))
    return (copied.filter("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select("_row.*"))
