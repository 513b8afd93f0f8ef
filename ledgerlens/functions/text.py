"""Accent-free text (I1), the search column (P7) and word search (F1).

Spark has no Unicode normalisation function, so NFKD runs in an Arrow UDF; everything else stays in JVM expressions.  The same Python
function normalises the search query on the driver, so query words and the
stored column always agree.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def plain(value: object) -> str:
    """Lower-case ASCII skeleton of a text: compatibility forms taken apart,
    marks and foreign letters gone; anything but a text is empty."""
    parts = unicodedata.normalize("NFKD", value) if isinstance(value, str) else ""
    return _BEYOND_ASCII.sub("", parts).lower()


@F.arrow_udf(T.StringType())
def normalize(s: pa.Array) -> pa.Array:
    """``plain`` over an Arrow batch: the one kernel of columns and queries.

    ASCII texts have no compatibility forms and are only lower-cased, a batch
    at once; the others go through ``plain`` one by one.
    """
    texts = pc.fill_null(s.cast(pa.string()), "")
    beyond = pc.invert(pc.string_is_ascii(texts))
    low = pc.ascii_lower(texts)
    some = texts.filter(beyond)
    return pc.replace_with_mask(low, beyond, pa.array([plain(x) for x in some.to_pylist()], pa.string()))


def search_text(entity: Column, supplier: Column, reference: Column) -> Column:
    """Normalised ``entity | supplier | reference`` (null parts -> '')."""
    joined = F.concat_ws(" | ", F.coalesce(entity.cast("string"), F.lit("")),
                         F.coalesce(supplier.cast("string"), F.lit("")),
                         F.coalesce(reference.cast("string"), F.lit("")))
    return normalize(joined)


def query_words(query: str | None) -> list[str]:
    """The words of a query, written as the stored column is."""
    return plain(query).split()


def contains_all_words(col: Column, query: str | None) -> Column | None:
    """Predicate: the column contains every query word as a literal substring.

    Returns ``None`` for an empty query (no filter).  Words are literals,
    never patterns: ``(`` or ``.`` match themselves.
    """
    words = query_words(query)
    if not words:
        return None
    return reduce(lambda a, b: a & b, [F.contains(col, F.lit(w)) for w in words])
