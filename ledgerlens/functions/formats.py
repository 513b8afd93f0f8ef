"""Display formats (I2-I8) as JVM column expressions.

``format_number`` rounds half-even on the exact binary value, as Python's
``format`` does, so these agree with the reference's f-strings.  Non-finite
and missing numbers render as an em dash.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
ELLIPSIS = "…"
UNDER_ONE_PCT = "under 1%"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _plain(x: Column, decimals: int) -> Column:
    """Fixed decimals, no grouping, decimal comma."""
    return F.translate(F.regexp_replace(F.format_number(x, decimals), ",", ""), ".", ",")


def money(x: Column) -> Column:
    """$1,24 B / $1,89 mil M / $322 M / $97.512 with a leading sign."""
    x = x.cast("double")
    v = F.abs(x)
    body = (F.when(v >= 1e12, F.concat(_plain(v / 1e12, 2), F.lit(" B")))
            .when(v >= 1e9, F.concat(_plain(v / 1e9, 2), F.lit(" mil M")))
            .when(v >= 1e6, F.concat(_plain(v / 1e6, 0), F.lit(" M")))
            .otherwise(F.translate(F.format_number(v, 0), ",", ".")))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(_finite(x), F.concat(sign, F.lit("$"), body)).otherwise(F.lit(DASH))


def integer(x: Column) -> Column:
    """Truncate toward zero, dot thousands; missing -> dash."""
    x = x.cast("double")
    n = F.when(_finite(x), x).try_cast("bigint")
    return F.coalesce(F.translate(F.format_number(n, 0), ",", "."), F.lit(DASH))


def percent(part: Column, total: Column) -> Column:
    """I4: share as a whole percent; total 0 -> dash; (0, 1) -> 'under 1%'."""
    p = F.try_divide(part.cast("double"), total.cast("double")) * 100
    return (F.when(total.isNull() | (total == 0), F.lit(DASH))
            .when((p > 0) & (p < 1), F.lit(UNDER_ONE_PCT))
            .otherwise(F.concat(F.regexp_replace(F.format_number(p, 0), ",", ""), F.lit("%"))))


def whole_percent(p: Column) -> Column:
    """A ratio already in percent, half-even to a whole number."""
    return F.when(_finite(p.cast("double")),
                  F.concat(F.regexp_replace(F.format_number(p, 0), ",", ""), F.lit("%")))


def name_cut(x: Column, n: int = 60) -> Column:
    """Trim; longer than ``n`` -> first n-1 chars, right-trimmed, + '…'."""
    t = F.trim(x.cast("string"))
    return F.when(F.length(t) <= n, t).otherwise(
        F.concat(F.regexp_replace(F.substring(t, 1, n - 1), r"\s+$", ""), F.lit(ELLIPSIS)))


def escape_dollar(x: Column) -> Column:
    """Escape ``$`` for Markdown renderers (at export time only)."""
    return F.replace(x, F.lit("$"), F.lit("\\$"))


def added_days_text(x: Column) -> Column:
    """I7: '+n d', missing -> '+0 d'."""
    n = F.coalesce(x.cast("double"), F.lit(0.0)).try_cast("bigint")
    return F.concat(F.lit("+"), F.coalesce(n.cast("string"), F.lit(DASH)), F.lit(" d"))


def share_text(p: Column) -> Column:
    """I8: one decimal with a decimal comma, e.g. '12,5%'."""
    return F.concat(_plain(p, 1), F.lit("%"))
