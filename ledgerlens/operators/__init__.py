"""Operators over DataFrames: derived columns, exact percentiles, entity
statistics, risk signals, the Isolation Forest and small report helpers."""
