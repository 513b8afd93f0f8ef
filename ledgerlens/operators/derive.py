"""Row-local derived columns (P1-P6, P9-P11).  All are JVM expressions in
one projection, so they fuse into a single whole-stage-codegen span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BAND_EDGES, BAND_LABELS, DIRECT_MARKER, RISK_LABELS
from ..functions.text import search_text
from ..functions.url import url_column

MICROS_PER_DAY = 86_400_000_000
# Plain decimal numbers (and inf / infinity / nan, which pandas also reads);
# rejects Spark-only forms such as '1d' or '1f'.
_NUMERIC_TEXT = (r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$")


def to_number(df: DataFrame, name: str) -> Column:
    """Numeric coercion; unparseable, NaN and non-numeric -> null."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        c = F.when(c.rlike(_NUMERIC_TEXT), F.expr(f"try_cast(`{name}` as double)"))
    elif isinstance(dtype, T.BooleanType):
        c = c.cast("double")
    elif isinstance(dtype, T.NumericType):
        c = c.cast("double")
    else:
        return F.lit(None).cast("double")
    return F.nullif(c, F.lit(float("nan")))


def to_timestamp_ntz(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType, T.StringType)):
        return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz") \
            if isinstance(dtype, T.StringType) else c.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def duration_days(start: Column, end: Column) -> Column:
    """floor((end - start) / 24 h); -12 h -> -1 (not calendar days)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS_PER_DAY))


def value_band(value: Column) -> Column:
    """P5: left-closed band index 0..3; negative, null and +inf -> null."""
    expr = F.lit(None).cast("int")
    for i in reversed(range(len(BAND_EDGES) - 1)):
        lo, hi = BAND_EDGES[i], BAND_EDGES[i + 1]
        expr = F.when((value >= F.lit(lo)) & (value < F.lit(hi)), F.lit(i)).otherwise(expr)
    return expr


def band_label(band: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in BAND_LABELS]), band + 1)


def risk_label(signals: Column) -> Column:
    """P10: 0..3 signals -> ordered label (sort on ``signals``)."""
    return F.try_element_at(F.array(*[F.lit(x) for x in RISK_LABELS]), signals + 1)


def derive(contracts: DataFrame) -> DataFrame:
    """P1-P8 on canonical contracts; the raw URL column is dropped."""
    df = contracts
    start = to_timestamp_ntz(df, "start_at")
    end = to_timestamp_ntz(df, "end_at")
    signed = to_timestamp_ntz(df, "signed_at")
    value = to_number(df, "value")
    added = to_number(df, "added_days")
    raw_dur = duration_days(start, end)
    inverted = F.coalesce(raw_dur < 0, F.lit(False))
    is_direct = F.coalesce(F.lower(F.col("modality").cast("string"))
                           .contains(DIRECT_MARKER), F.lit(False)).cast("int")
    out = df.select(
        F.col("entity").cast("string").alias("entity"),
        F.col("contract_id").cast("string").alias("contract_id"),
        F.col("reference").cast("string").alias("reference"),
        F.col("modality").cast("string").alias("modality"),
        F.col("supplier").cast("string").alias("supplier"),
        F.col("is_sme").cast("boolean").alias("is_sme"),
        value.alias("value"),
        added.alias("added_days"),
        signed.alias("signed_at"),
        start.alias("start_at"),
        end.alias("end_at"),
        F.when(~inverted, raw_dur).alias("duration_days"),
        inverted.alias("dates_inverted"),
        is_direct.alias("is_direct"),
        value_band(value).alias("value_band"),
        F.year(signed).cast("int").alias("sign_year"),
        search_text(F.col("entity"), F.col("supplier"), F.col("reference")).alias("search_text"),
        url_column(df).alias("url"),
    )
    return out.withColumn("value_band_label", band_label(F.col("value_band")))
