"""Process-URL extraction (P8): unwrap ``{url: ...}`` or take the bare
string, keep it only when it starts with ``http``; anything else -> null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def url_column(df: DataFrame, name: str = "process_url") -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StructType):
        if "url" not in dtype.fieldNames():
            return F.lit(None).cast("string")
        u = c.getField("url")
        if not isinstance(dtype["url"].dataType, T.StringType):
            return F.lit(None).cast("string")
    elif isinstance(dtype, T.MapType):
        u = F.try_element_at(c, F.lit("url"))
        if not isinstance(dtype.valueType, T.StringType):
            return F.lit(None).cast("string")
    elif isinstance(dtype, T.StringType):
        u = c
    else:  # numbers, booleans, arrays: never a link
        return F.lit(None).cast("string")
    return F.when(u.startswith("http"), u).cast("string")
