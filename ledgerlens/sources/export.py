"""Prioritised export (S6): every row of the view flagged by the rules or by
the model, thirteen columns in a fixed order, written by Spark as CSV.

Spark writes ``true/false`` and no byte-order mark; both are documented
differences from a spreadsheet-oriented export, not emulated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ("reference", "entity", "value", "added_days", "modality", "risk_label",
                  "sig_value", "sig_direct", "sig_added", "entity_direct_rate",
                  "is_anomaly", "anomaly_score", "url")


def export_frame(view_rows: DataFrame) -> DataFrame:
    return (view_rows.where(F.col("rule_priority") | F.col("is_anomaly"))
            .select(*EXPORT_COLUMNS))


def write_csv(view_rows: DataFrame, path: str) -> None:
    """All flagged rows of the view (not only the first 50), with a header."""
    export_frame(view_rows).write.mode("overwrite").option("header", True).csv(path)
