"""License scans by a positional index of rare licence words.

A small library of licence notices is indexed by word and position.  For
each file, the words of highest IDF of every notice are looked up; an
occurrence at word ``i`` of a word that stands at ``k`` in a notice votes
for the notice beginning at ``i - k``.  Beginnings with enough votes are
compared word by word (weighed by IDF), and count only if a mandatory key
phrase of the notice stands there.  IDF comes from all given documents.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased.  Null and empty texts have no words, no labels and score 0.
Repeated rows are scanned one by one; whole texts are read, however long.
An empty table gives an empty result.  Columns other than those named are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

ANCHORS = 3        # words of highest IDF by which a notice is looked up
LEAST_SHARE = 0.8  # of a notice's IDF that must stand in place

# Phrases whose places every scan reports, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"),
                ("general public license", "gpl"))

# Notices as (label, wording, mandatory key phrases).
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files", ("permission is hereby granted",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3",
     ("general public license",)),
    ("gpl", "the terms of the gnu general public license as published by the free software "
            "foundation", ("general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted", ("redistribution and use",)),
    ("mpl", "subject to the terms of the mozilla public license version 2 0",
     ("mozilla public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return _WORDS.findall(data.lower())  # bytes.lower() changes A-Z alone


def _split(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().split())


@dataclass(frozen=True)
class Index:
    """Notices with the weights of their words, and the postings of the anchors."""

    notices: tuple[tuple, ...]                            # (label, words, keys)
    idf: dict[bytes, float]
    postings: dict[bytes, tuple[tuple[int, int], ...]]    # anchor -> (notice, position)
    needed: tuple[int, ...]                               # votes that a beginning needs
    base: dict[bytes, tuple[tuple, ...]]                  # first word -> (words, label)


def vocabulary(notices=NOTICES, base=BASE_PHRASES) -> set[bytes]:
    return {w for _, text, _ in notices for w in _split(text)} | {
        w for phrase, _ in base for w in _split(phrase)}


def build_index(files_with: dict[bytes, int], files: int, notices=NOTICES,
                base=BASE_PHRASES) -> Index:
    idf = {w: math.log((files + 1) / (files_with.get(w, 0) + 1)) + 1
           for w in vocabulary(notices, base)}
    rows = tuple((label, _split(text), tuple(_split(k) for k in keys))
                 for label, text, keys in notices)
    postings: dict[bytes, list] = {}
    needed = []
    for t, (_, words, _) in enumerate(rows):
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:ANCHORS]
        spots = [(w, k) for k, w in enumerate(words) if w in rare]
        for w, k in spots:
            postings.setdefault(w, []).append((t, k))
        needed.append(min(2, len(spots)))
    starts: dict[bytes, list] = {}
    for phrase, label in base:
        starts.setdefault(_split(phrase)[0], []).append((_split(phrase), label))
    return Index(rows, idf, {w: tuple(p) for w, p in postings.items()}, tuple(needed),
                 {w: tuple(p) for w, p in starts.items()})


def _has(words: list[bytes], key: tuple[bytes, ...], low: int, high: int) -> bool:
    n = len(key)
    return any(tuple(words[i:i + n]) == key for i in range(max(low, 0), high - n + 1))


def scan(words: list[bytes], index: Index) -> dict:
    """Places of the base phrases, labels and score of one file."""
    idf, postings, base = index.idf, index.postings, index.base
    places, base_labels = [], set()
    votes: Counter = Counter()
    for i, w in enumerate(words):
        if w not in idf:
            continue
        for phrase, label in base.get(w, ()):
            if tuple(words[i:i + len(phrase)]) == phrase:
                places.append(i)
                base_labels.add(label)
        for t, k in postings.get(w, ()):
            votes[t, i - k] += 1
    labels, best, spans = set(base_labels), 0.0, []
    for (t, start), n in votes.items():
        if n < index.needed[t]:
            continue
        label, notice, keys = index.notices[t]
        total = sum(idf[w] for w in notice)
        found = sum(idf[w] for k, w in enumerate(notice)
                    if 0 <= start + k < len(words) and words[start + k] == w)
        if not any(_has(words, key, start, min(start + len(notice), len(words))) for key in keys):
            continue
        best = max(best, found / total)
        if found >= LEAST_SHARE * total:
            labels.add(label)
            spans.append((label, max(start, 0), start + len(notice)))
    return {"n_words": len(words), "n_base": len(places),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
            "score": min(best, 1.0),
            "spans": [{"label": a, "start_word": b, "end_word": c} for a, b, c in sorted(spans)]}


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Of every licence word, over all documents; and the number of documents."""
    known = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            for data in b.column(0).to_pylist():
                found.update(known.intersection(words_of(data)))
        found[b""] = rows
        yield pa.record_batch([pa.array(found.keys(), pa.binary()),
                               pa.array(found.values(), pa.int64())], ["word", "n"])

    counts = (docs.select(F.encode("text", "UTF-8").alias("data"))
              .mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    got = {bytes(r["word"]): r["n"] for r in counts.collect()}  # at most the library's words
    return got, got.pop(b"", 0)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label: string, start_word: long, end_word: long>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: counts, labels, score and the spans of the notices."""
    spark = ready(docs)
    index = spark.sparkContext.broadcast(build_index(*document_frequencies(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
                 "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
                 "score": pa.float64(), "spans": pa.list_(pa.struct([
                     ("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64())]))}
        for b in batches:
            got = [scan(words_of(x), index.value) for x in b.column("data").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), *[pa.array([g[k] for g in got], t) for k, t in kinds.items()]],
                ["doc_id", *kinds])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.encode("text", "UTF-8").alias("data")).mapInArrow(run, SCHEMA))
