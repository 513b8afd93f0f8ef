"""Risk signals R1-R3 and their summary columns P9-P11.

Thresholds arrive as scalars (J2): they are literals in the projection,
so the signals cost nothing beyond the row scan and stay in codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from .derive import risk_label
from .stats import Thresholds


def _lit(x):
    return F.lit(x).cast("double")


def add_signals(rows: DataFrame, th: Thresholds, params: Params = DEFAULT) -> DataFrame:
    """``rows`` must carry the entity lookup columns."""
    sig_value = F.coalesce(F.col("value") > _lit(th.t_value), F.lit(False))
    if th.t_direct is None:
        sig_direct = F.lit(False)
    else:
        sig_direct = F.coalesce(
            (F.col("is_direct") == 1)
            & (F.col("entity_contracts") >= params.min_entity_contracts)
            & (F.col("entity_direct_rate") > _lit(th.t_direct)), F.lit(False))
    if th.t_added is None:
        sig_added = F.lit(False)
    else:
        sig_added = F.coalesce(F.coalesce(F.col("added_days"), F.lit(0.0)) > _lit(th.t_added),
                               F.lit(False))
    signals = sig_value.cast("int") + sig_direct.cast("int") + sig_added.cast("int")
    return (rows.withColumn("sig_value", sig_value)
            .withColumn("sig_direct", sig_direct)
            .withColumn("sig_added", sig_added)
            .withColumn("signals", signals)
            .withColumn("risk_label", risk_label(F.col("signals")))
            .withColumn("rule_priority", F.col("signals") >= 2))
