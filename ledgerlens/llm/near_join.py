"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct 5-word shingles (the whole
sequence, if it has fewer words).  Two documents link when the Jaccard
similarity of their sets reaches the threshold; the result names each
document's component of links.

Method.  All shingles stand in one order: first those that no second
document has, then the others by hash, last the frequent ones by document
frequency.  Similar sets must share a shingle in their prefixes in that
order.  A rare shingle of a prefix is a signature by itself.  Frequent
shingles fall into classes and are indexed as pairs of one class, for which
each class in use extends the prefix by one shingle: two prefixes that share
more shingles than there are classes share two of one class.  Documents that
meet under a signature, and whose sizes and remaining shingles allow the
threshold, are verified on their sets.

Exactness.  Document frequencies and the map of shingles that two documents
have come from all documents; hash collisions in them only cost speed.
Equal sets are joined by a 128-bit hash; signatures that share a document of
hot copies hold it once.  Under each signature all documents are first
compared with one pivot; then only pairs of documents whose components still
differ and whose parity maps (an upper bound of the overlap) allow the
threshold.  No candidate is dropped.

Sizes.  The map (``MAP_BITS`` bits) and the list of frequent shingles (at
most ``FREQUENT``) have fixed sizes and go to every executor.  With more
data the map fills and more signatures are written; the result is the same.

Null and empty texts, and texts without words, have empty sets and form
components of their own.  A null doc_id links with nothing and has a null
component.  Components are of sets, whatever their keys: rows with equal
doc_id and different texts are different documents.  A component is named
by its smallest doc_id.  An empty table gives an empty result.  Columns other than those
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ready, shuffle_width, word_count

WORDS = 5            # of a shingle
PERCENT = 75         # least similarity
MAP_BITS = 27        # 2 ** MAP_BITS bits: shingles that two documents have
FREQUENT = 1 << 17   # most shingles that count as frequent
LEAST_FREQUENT = 16  # documents that a frequent shingle has at least
CHUNK = 1_000_000    # shingles counted at a time in a task
PARITY = 512         # bits of a set's parity map

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:  # bounded memory in long tasks
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, seen: _Words, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, np.uint64(take))
    for k in range(take):
        out = out * _P + h[k:len(h) - take + 1 + k]
    return np.unique(_mix(out))


def _key39(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(25)


# --- document frequencies ------------------------------------------------------------------

def _counted(slices_bits: int, width: int):
    """Per chunk of distinct texts: 32 bits of each shingle and its number of documents, by slice."""
    cols = ["slice", "keys", "many", "times"]

    def emit(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(_key39(np.concatenate(sets)), return_counts=True)
        at = np.searchsorted(keys, np.arange((1 << slices_bits) + 1, dtype=np.uint64)
                             << np.uint64(39 - slices_bits))
        rows = []
        for s in range(1 << slices_bits):
            part, c = keys[at[s]:at[s + 1]], n[at[s]:at[s + 1]]
            more = np.flatnonzero(c > 1)
            low = part & ((np.uint64(1) << np.uint64(39 - slices_bits)) - np.uint64(1))
            rows.append((s, low.astype(np.uint32).tobytes(), more.astype(np.uint32).tobytes(),
                         c[more].astype(np.uint32).tobytes()))
        return pa.record_batch([pa.array(x, t) for x, t in zip(
            zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known, sets, held = _Words(), set(), [], 0
        for b in batches:
            for data in b.column("data").to_pylist():
                s = shingles(data, seen, width)
                name = xxhash.xxh128_digest(s.tobytes())
                if not len(s) or name in known:
                    continue
                known.add(name)
                sets.append(s)
                held += len(s)
                if held >= CHUNK:
                    yield emit(sets)
                    sets, held = [], 0
        if sets:
            yield emit(sets)
    return run


def _reduced(slices_bits: int, most: int):
    """One slice of the map and its most frequent shingles."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = [], []
        for k, m, t in zip(rows["keys"], rows["many"], rows["times"]):
            keys.append(np.frombuffer(k, np.uint32))
            c = np.ones(len(keys[-1]), np.uint32)
            c[np.frombuffer(m, np.uint32)] = np.frombuffer(t, np.uint32)
            times.append(c)
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[:len(keys)]
        df = np.add.reduceat(times, first) if len(first) else times
        keys = keys[first].astype(np.uint64)
        bits = np.zeros(1 << (MAP_BITS - slices_bits), bool)
        bits[keys[df >= 2] >> np.uint64(39 - MAP_BITS)] = True
        top = np.flatnonzero(df >= LEAST_FREQUENT)
        top = top[np.lexsort((keys[top], -df[top].astype(np.int64)))][:most]
        full = keys[top] | (np.uint64(key[0]) << np.uint64(39 - slices_bits))
        return pd.DataFrame([(key[0], np.packbits(bits).tobytes(), full.tobytes(),
                              df[top].astype(np.uint32).tobytes())],
                            columns=["slice", "bits", "keys", "df"])
    return run


def shared_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map, and the frequent shingles' keys (sorted) with their document frequencies."""
    tasks = docs.rdd.getNumPartitions()  # one slice holds a fixed share of one task's input
    bits = min(20, max(7, (4 * tasks - 1).bit_length()))  # at least 7: keys of 39 bits, 32 written
    counted = docs.select("data").mapInArrow(
        _counted(bits, width), "slice int, keys binary, many binary, times binary")
    got = counted.groupBy("slice").applyInPandas(
        _reduced(bits, max(1, FREQUENT >> bits)),
        "slice int, bits binary, keys binary, df binary").collect()  # fixed size in all
    table = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    step = len(table) >> bits
    for r in got:
        table[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    keys = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["keys"], np.uint64) for r in got]])
    df = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(r["df"], np.uint32) for r in got]])
    order = np.argsort(keys)
    return table, keys[order], df[order]


# --- signatures ----------------------------------------------------------------------------

def in_map(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens >> np.uint64(64 - MAP_BITS)
    return (table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any similar set, at least."""
    return -(-percent * n // 100)


def bands(n: int, percent: int) -> set[int]:
    """Powers of two below the smaller set of any similar pair that holds a set of ``n``."""
    return {least_overlap(n, percent).bit_length() - 1, n.bit_length() - 1}


def signatures(tokens: np.ndarray, shared: np.ndarray, rank: np.ndarray,
               percent: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Signatures of a set and the shingles that remain from each on; None if it has no partner.

    ``shared``: whether a second document may have the shingle; ``rank``: of
    the frequent ones, from 1 for the least frequent; else 0.
    """
    n = len(tokens)
    need = n - least_overlap(n, percent) + 1  # units of the prefix
    alone = n - int(shared.sum())
    if alone >= need:
        return None
    rare = tokens[shared & (rank == 0)]
    singles = rare[:need - alone]
    sigs, rests = [singles], [n - alone - np.arange(len(singles))]
    need -= alone + len(rare)
    if need > 0:
        often = np.flatnonzero(shared & (rank > 0))
        often = tokens[often[np.argsort(rank[often], kind="stable")]]
        for band in bands(n, percent):
            classes = max(1, (1 << band) // 8)
            kind = _mix(often) % np.uint64(classes)
            opens = np.zeros(len(often), bool)
            opens[np.unique(kind, return_index=True)[1]] = True
            units = np.cumsum(~opens)
            prefix = int(np.searchsorted(units, need)) + 1
            by = np.argsort(kind[:prefix], kind="stable")
            k, t = kind[:prefix][by], often[:prefix][by]
            for gap in range(1, len(t)):
                same = k[gap:] == k[:-gap]
                if not same.any():
                    break
                pair = (t[:-gap][same] * _P + t[gap:][same]) * _P + np.uint64(band + 1)
                sigs.append(_mix(pair))
                rests.append(np.full(int(same.sum()), n - alone - len(rare)))
    return np.concatenate(sigs), np.concatenate(rests)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit k: whether an odd number of the shingles hash to k."""
    odd = np.bincount((_mix(tokens ^ _P) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


SETS = ("doc_id long, tag binary, n long, name binary, keys array<long>, sigs array<long>, rests array<int>, "
        "parity array<long>")


def _described(sent, width: int, percent: int, nulls: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often, df = sent.value
        order = np.empty(len(often), np.int64)
        order[np.lexsort((often, df))] = np.arange(1, len(often) + 1)
        seen, known = _Words(), set()
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for b in batches:
            sizes, names, keys, sigs, rests, parities = [], [], [], [], [], []
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist()):
                s = shingles(data, seen, width)
                name = xxhash.xxh128_digest(s.tobytes())
                got = None
                # a copy needs no signatures of its own; nor do rows without doc_id, unless they take part
                if len(s) and (nulls or doc is not None) and name not in known:
                    known.add(name)
                    shared = in_map(table, s)
                    rank = np.zeros(len(s), np.int64)
                    if len(often) and shared.any():
                        at = np.minimum(np.searchsorted(often, _key39(s)), len(often) - 1)
                        rank = np.where(often[at] == _key39(s), order[at], 0)
                    got = signatures(s, shared, rank, percent)
                sizes.append(len(s))
                names.append(name)
                keys.append(None if got is None else s[shared].view(np.int64))
                sigs.append(None if got is None else got[0].view(np.int64))
                rests.append(None if got is None else got[1].astype(np.int32))
                parities.append(None if got is None else parity(s))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("tag"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(keys, longs), pa.array(sigs, longs), pa.array(rests, ints),
                 pa.array(parities, longs)],
                ["doc_id", "tag", "n", "name", "keys", "sigs", "rests", "parity"])
    return run


# --- candidates, verification, components ----------------------------------------------------

def _can_link(percent: int, a: str, b: str) -> Column:
    """Whether the shingles that remain allow the threshold."""
    least = F.least(F.col(f"rest_{a}"), F.col(f"rest_{b}"))
    return (100 + percent) * least >= percent * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def _parity_allows(percent: int, a: str, b: str) -> Column:
    """Whether the parity maps allow the threshold: sets differ by at least their distance."""
    words = [F.bit_count(F.col(f"parity_{a}")[i].bitwiseXOR(F.col(f"parity_{b}")[i]))
             for i in range(PARITY // 64)]
    both = F.col(f"n_{a}") + F.col(f"n_{b}")
    return (100 + percent) * (both - sum(words[1:], words[0])) >= 2 * percent * both


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose sets are similar enough."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"),
                           F.col("keys").alias(f"keys_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    return both.filter((100 + percent) * common >= percent * (F.col("n_a") + F.col("n_b"))
                       ).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, of every node with a link.

    Alternates large and small stars until nothing changes; a node's
    neighbours are only ever aggregated, never gathered.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"),
                           F.sum(F.col("v") % 1_000_003)).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct())
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut(small)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _components(docs: DataFrame, tag: Column, nulls: bool, width: int = WORDS,
                percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, tag, n, name`` of each row, ``name, node, least`` of each set, ``node, root`` of linked ones.

    Nodes are numbers of the sets in the order of their smallest doc_id, then
    name.  ``nulls``: whether rows with a null doc_id take part (at the end).
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = ready(docs)
    texts = docs.select(F.col("doc_id").cast("long"), tag.alias("tag"),
                        F.encode("text", "UTF-8").alias("data"))
    sent = spark.sparkContext.broadcast(shared_shingles(texts, width))  # of fixed size
    described = cut(texts.mapInArrow(_described(sent, width, percent, nulls), SETS))
    sent.unpersist()

    named = described.filter("n > 0" if nulls else "n > 0 AND doc_id IS NOT NULL")
    order = [F.col("least").asc_nulls_last(), F.col("name")]
    nodes = cut(named.groupBy("name").agg(F.min("doc_id").alias("least"))
                .repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
                .withColumn("node", F.monotonically_increasing_id()))  # pinned by the cut
    full = (named.filter("sigs IS NOT NULL").groupBy("name").agg(
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sigs").alias("sigs"),
        F.first("rests").alias("rests"), F.first("parity").alias("parity")))
    sets = cut(full.join(nodes.select("name", "node"), "name").drop("name"))
    entries = sets.select("node", "n", F.explode(F.arrays_zip("sigs", "rests")).alias("e")).select(
        F.col("e.sigs").alias("sig"), F.col("node").alias("b"), F.col("n").alias("n_b"),
        F.col("e.rests").alias("rest_b"))

    # The document that meets most others -- an original among its copies -- is compared
    # with all others under a signature.
    held = entries.groupBy("sig").agg(F.count("*").alias("held")).filter("held > 1")
    met = entries.join(held, "sig")  # under signatures of two documents or more
    fame = met.groupBy("b").agg(F.sum("held").alias("fame"))
    met = cut(met.join(fame, "b").drop("held"))
    pivots = met.groupBy("sig").agg(F.max(F.struct(
        "fame", (-F.col("b")).alias("neg"), "n_b", "rest_b")).alias("p")).select(
        "sig", (-F.col("p.neg")).alias("a"), F.col("p.n_b").alias("n_a"),
        F.col("p.rest_b").alias("rest_a"))
    star = met.join(pivots, "sig").filter(
        (F.col("a") != F.col("b")) & _can_link(percent, "a", "b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(_verified(star, sets, percent))
    roots = cut(components(links))

    # Then all pairs under one signature whose components still differ.
    labelled = met.select("sig", "b", "n_b", "rest_b").join(
        roots.withColumnRenamed("node", "b"), "b", "left").withColumn(
        "root", F.coalesce("root", "b"))
    apart = labelled.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter(
        "r0 <> r1").select("sig")
    left = cut(labelled.join(apart, "sig").join(
        sets.select(F.col("node").alias("b"), F.col("parity").alias("parity_b")), "b"))
    right = left.select("sig", *[F.col(f"{c}_b" if c else "b").alias(f"{c}_a" if c else "a")
                                 for c in ("", "n", "rest", "parity")], F.col("root").alias("root_a"))
    crossing = (left.join(right, "sig").filter(
        (F.col("root_a") < F.col("root")) & _can_link(percent, "a", "b")
        & _parity_allows(percent, "a", "b")).select("a", "b").distinct())
    more = cut(_verified(crossing, sets, percent))
    return described, nodes, components(links.union(more))


def near_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document."""
    described, nodes, roots = _components(docs, F.lit(None).cast("binary"), False, width, percent)
    linked = roots.join(nodes.select(F.col("node").alias("root"), F.col("least").alias("label")), "root")
    named_roots = nodes.join(linked, "node", "left").select(
        "name", F.coalesce("label", "least").alias("component_id"))
    return (described.select("doc_id", "n", "name").join(named_roots, "name", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id"))
                    .when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of smallest doc_id.

    Only rows that are linked or equal to one that stays are removed: rows
    that share a doc_id but no text stay, and a row with a null doc_id stays
    unless another row is its copy.  Of rows without words those that repeat
    both doc_id and text are removed, and none with a null doc_id.
    """
    tag = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))  # null apart from empty
    described, nodes, roots = _components(docs, tag, True, **kw)
    first = nodes.join(roots.filter("root <> node"), "node", "left_anti").select("name")
    row = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"),
                   F.col("tag").alias("_tag"))
    key = ["_none", "_id", "_tag"]
    leaders = (described.filter("n > 0").join(first, "name", "left_semi").groupBy("name")
               .agg(F.min(row).alias("r")).select("r.*")
               .unionByName(described.filter("n = 0 AND doc_id IS NOT NULL").select(row.alias("r"))
                            .select("r.*")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").isNull().alias("_none"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), tag.alias("_tag"),
                       (word_count(F.col("text")) == 0).alias("_empty"))
    kept = rows.join(leaders, key, "left_semi").dropDuplicates(key)
    return kept.unionByName(rows.filter("_none AND _empty")).select("_row.*")
