"""Toxicity scores by FTRL-proximal logistic regression on hashed word features.

Features of a whole text, each counted once: its lower-case words, their
first four letters, word pairs and skip-grams (pairs with one word between),
hashed into ``2**BITS`` coordinates.  FTRL-proximal learns one document at a
time with a rate per coordinate; its L1 term leaves most weights at exactly
0, so the model that goes to the executors is a short list of coordinates.

The model is fitted on at most ``MAX_TRAIN`` labelled rows: those of the
smallest hashes of doc_id.  Rows whose crc32(doc_id as text) mod 3 is 1 are
held out: their labels are never read.  A doc_id labelled twice counts as
toxic if one label says so.

Null and empty texts have no features and get the model's base score; a null
doc_id is never used in learning and is not held out.  Repeated rows count
once in learning and are scored one by one; texts of any length are read
whole.  Without any labelled
row every score is 0.  An empty table gives an empty result.  Columns other
than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ready

BITS = 20
MAX_TRAIN = 8192   # labelled rows that the model is fitted on
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.3
THRESHOLD = 0.7
STEM = 4           # letters of a word's beginning

_LETTERS = re.compile(r"[^\W\d_]+")
_M1, _M2, _M3, _M4, _M5 = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F))


class _Hashes(dict):
    """Word -> hash of the word and of its beginning, in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:  # bounded memory in long tasks
            self.clear()
        h = zlib.crc32(word.encode()) << 32 | zlib.crc32(word[:STEM].encode(), 7)
        self[word] = h
        return h


def coordinates(text: str | None, seen: _Hashes) -> np.ndarray:
    """Coordinates of the features of a whole text, with repeats."""
    words = _LETTERS.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    word, stem = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    mixed = [word * _M1, stem * _M2, word[:-1] * _M3 + word[1:] * _M4,
             word[:-2] * _M5 + word[2:] * _M4]
    return (np.concatenate(mixed) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weights other than 0 by coordinate, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Per-coordinate FTRL-proximal over rows of distinct coordinates; the bias is not penalised."""
    if not rows:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), -1e9)
    positives = sum(y for _, y in rows)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = float(np.log((positives + 0.5) / (len(rows) - positives + 0.5))), 1.0
    for _ in range(epochs):
        for at, y in rows:
            za, na = z[at], n[at]
            w = -np.sign(za) * np.maximum(np.abs(za) - L1, 0) / ((BETA + np.sqrt(na)) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - y
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g * g
            bias_n += g * g
            bias -= ALPHA * g / np.sqrt(bias_n)
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    index = np.flatnonzero(w)
    return Model(index, w[index].astype(np.float32), bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for b in batches:
        at = [np.unique(coordinates(t, seen)).astype(np.int32).tobytes()
              for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("order"), b.column("toxic"), pa.array(at, pa.binary())],
                              ["order", "toxic", "at"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN,
        epochs: int = EPOCHS) -> Model:
    """Fits the model on the labelled documents that are not held out."""
    ready(docs)
    known = (labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = F.xxhash64(F.lit("train"), "doc_id").alias("order")
    sample = known.select("doc_id", "toxic", order).orderBy("order", "doc_id").limit(max_train)
    # At most max_train rows of three numbers: small enough to send everywhere.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = (chosen.select("order", "toxic", "text")
            .mapInArrow(_features, "order long, toxic int, at binary")
            .distinct().orderBy("order", "at").limit(max_train).collect())
    return ftrl([(np.frombuffer(r["at"], np.int32), r["toxic"]) for r in rows], epochs)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``score``, ``predicted``."""
    spark = ready(docs)
    sent = spark.sparkContext.broadcast(model)

    def scores(parts: Iterator[tuple]) -> Iterator:
        import pandas as pd
        weights, bias, seen = sent.value.dense(), sent.value.bias, _Hashes()
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                at = coordinates(text, seen)
                hit = at[weights[at] != 0]
                total = bias + float(weights[np.unique(hit)].sum(dtype=np.float64))
                out[i] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pd.Series(out)

    udf = F.pandas_udf(_typed(scores), "double")
    scored = docs.withColumn("score", udf(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _typed(f):
    import pandas as pd
    f.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


def toxicity(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels, **kw)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic."""
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), "text")
    kept = score(rows, fit(docs, labels, **kw)).filter("predicted = 0")
    return kept.select("_row.*")
