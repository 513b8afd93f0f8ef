"""Hand-computable contract frames (canonical column names)."""

from __future__ import annotations

import datetime as dt

BASE = dt.datetime(2023, 1, 1)
SCHEMA = ("entity string, contract_id string, reference string, modality string, supplier string, "
          "is_sme boolean, value double, added_days bigint, signed_at timestamp_ntz, "
          "start_at timestamp_ntz, end_at timestamp_ntz")


DIRECT, TENDER = "Contratación directa", "Licitación pública"

# (buyer, contracts, of them direct awards); the last is too small to be judged.
# Shares of the judged ones: 1, 0.6, 0.2 and 0, so their 75th percentile is 0.7.
BUYERS = (("Harbour office", 50, 50), ("School board", 60, 36), ("Road agency", 40, 8),
          ("Water works", 33, 0), ("Chapel fund", 12, 12))


def contracts(spark, rows, schema=SCHEMA):
    """A frame of contracts from dicts; dates are days after ``BASE``."""
    def at(row, name, usual):
        days = row.get(name, usual)
        return days if days is None else BASE + dt.timedelta(days=days)

    def value(row):
        return None if row.get("value") is None else float(row["value"])

    data = [(r["entity"], r.get("id", f"K{k}"), r.get("ref", f"file {k}"), r["modality"],
             r.get("supplier", "Acme"), r.get("sme", True), value(r), r.get("added", 0),
             at(r, "signed", 0), at(r, "start", 0), at(r, "end", 100)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def buyers():
    """195 contracts of five buyers, each with a value of its own."""
    kinds = [(b, DIRECT if k < direct else TENDER) for b, n, direct in BUYERS for k in range(n)]
    return [{"entity": b, "modality": m, "value": 350_000 + 7_500 * k}
            for k, (b, m) in enumerate(kinds)]
