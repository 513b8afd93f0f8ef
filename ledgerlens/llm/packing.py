"""Best-fit packing with conflicts.

Documents are packed into sequences of ``capacity`` words.  A bin holds at
most ``per_source`` documents of a source (1 by default: a source with a
third of all rows then fills its bins badly) and at most one of a duplicate
cluster (equal texts).  Rows are dealt by a hash into lanes of about ``lane_rows`` rows;
each lane is packed by one task: the bins stand in order of their residual,
and the search starts at the tightest residual that holds the document and
goes on until a bin without conflict is found.

A document longer than a bin fills bins of its own with whole pieces; its
remainder is packed with the others.  Null or empty texts give one piece of
0 words and no bin.  Null sources are one source.  Repeated rows are packed
one by one, never two into a bin; a row that repeats very often is dealt in
chunks of copies.  A piece names its text by ``text_md5`` (of UTF-8; a null
text counts as empty), as a doc_id may stand on several texts or be null.
Very long texts are counted whole.  An empty table gives an empty result.
Columns other than those named are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ready, shuffle_width, word_count

CAPACITY = 1024
LANE_ROWS = 4096
LANES_A_TASK = 4
COPIES = 1000  # of a repeated row that a task deals at a time

SCHEMA = ("doc_id long, source string, size long, part int, start_word long, n_words long, "
          "bin_id long, text_md5 string")


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int,
             per_source: int = 1) -> list[int]:
    """Bin number of each item; items come in the order in which they are placed."""
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    in_sources: list[list[int]] = []  # bitmaps of each bin: sources held once, twice, ...
    in_clusters: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s_bit, c_bit = 1 << source, 1 << cluster
        k = bisect_left(order, (size, -1))
        while k < len(order):
            b = order[k][1]
            if not (in_sources[b][-1] & s_bit or in_clusters[b] & c_bit):
                break
            k += 1
        if k < len(order):
            left, b = order.pop(k)
        else:
            left, b = capacity, len(in_sources)
            in_sources.append([0] * per_source)
            in_clusters.append(0)
        held = next(k for k, bits in enumerate(in_sources[b]) if not bits & s_bit)
        in_sources[b][held] |= s_bit
        in_clusters[b] |= c_bit
        if left > size:  # a full bin is never a successor
            insort(order, (left - size, b))
        placed.append(b)
    return placed


def _lane(capacity: int, per_source: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        lane = int(rows["lane"].iloc[0])
        rows = rows.assign(rest=rows["size"] % capacity, whole=rows["size"] // capacity)
        rows = rows.sort_values(["rest", "doc_id", "cluster", "source", "copy"],
                                ascending=[False, True, True, True, True], kind="stable")
        packed = rows[rows["rest"] > 0]
        bins = best_fit(packed["rest"].tolist(),
                        pd.factorize(packed["source"], use_na_sentinel=False)[0].tolist(),
                        pd.factorize(packed["cluster"])[0].tolist(), capacity, per_source)
        of_rest = dict(zip(packed.index, bins, strict=True))
        used, out = max(bins, default=-1) + 1, []
        for r in rows.itertuples():
            for part in range(r.whole):
                out.append((r.doc_id, r.source, r.size, part, part * capacity, capacity, used, r.cluster))
                used += 1
            if r.rest or not r.size:
                out.append((r.doc_id, r.source, r.size, r.whole, r.whole * capacity, r.rest,
                            of_rest.get(r.Index), r.cluster))
        done = pd.DataFrame(out, columns=["doc_id", "source", "size", "part", "start_word",
                                          "n_words", "bin_id", "text_md5"])
        done["bin_id"] = done["bin_id"].astype("Int64") + (lane << 32)
        done["doc_id"] = done["doc_id"].astype("Int64")
        return done
    return pack


def _dealt(once: DataFrame) -> DataFrame:
    """Every row as often as it occurs (``n``), with the number of its ``copy``.

    The copies of a row are made where it lies, unless they are many: then
    chunks of ``COPIES`` are dealt first.
    """
    def copies(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.withColumn("copy", F.explode(F.sequence(first, last))).drop("n", "chunk")

    few = copies(once.where(F.col("n") <= COPIES), F.lit(1).cast("long"), F.col("n"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))
    many = once.where(F.col("n") > COPIES).withColumn("chunk", F.explode(chunks)).repartition("cluster", "chunk")
    start = F.col("chunk") * COPIES
    return few.unionByName(copies(many, start + 1, F.least(start + COPIES, F.col("n"))))


def pack(docs: DataFrame, capacity: int = CAPACITY, lane_rows: int = LANE_ROWS,
         per_source: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, source, size, part, start_word, n_words, bin_id, text_md5``."""
    ready(docs)
    items = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.md5(F.coalesce("text", F.lit(""))).alias("cluster"))
    # Equal rows are counted before they are dealt, so that no repeated row fills a lane.
    once = cut(items.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("n")))
    lanes = max(1, -(-(once.agg(F.sum("n")).first()[0] or 0) // lane_rows))
    lane = F.pmod(F.xxhash64(F.lit("lane"), "doc_id", "cluster", "copy"), F.lit(lanes))
    # A stated number of partitions, else the few bytes of all lanes would go into one task; a task
    # has several lanes, as one takes a fraction of a second and every file costs the executor a process.
    tasks = min(-(-lanes // LANES_A_TASK), 4 * shuffle_width(docs.sparkSession))
    return (_dealt(once).withColumn("lane", lane.cast("long")).repartition(tasks, "lane").groupBy("lane")
            .applyInPandas(_lane(capacity, per_source), SCHEMA))
