"""Method parameters, frozen.  Values marked FIXED must stay equal to the
method being reproduced, or the flags and bands change."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED values (must equal the reproduced method)
# ---------------------------------------------------------------------------
# Percentile levels and volume gate of the three risk signals.
PCT_HIGH_VALUE = 0.95
PCT_ADDED_DAYS = 0.90
PCT_DIRECT_PEERS = 0.75
MIN_ENTITY_CONTRACTS = 30
# Isolation Forest.
CONTAMINATION = 0.02
N_TREES = 200
SEED = 42
MIN_MODEL_ROWS = 50
MAX_SAMPLES = 256
# Value bands, left-closed: [0, 90e6) [90e6, 500e6) [500e6, 1e9) [1e9, inf).
BAND_EDGES = (0.0, 90e6, 500e6, 1e9, float("inf"))
BAND_LABELS = ("< 90 M", "90–500 M", "500 M–1 B", "> 1 B")
# Risk level per number of signals 0..3.
RISK_LABELS = ("Bajo", "Medio", "Alto", "Crítico")
# Substring (case-insensitive) that marks a direct award.
DIRECT_MARKER = "directa"
# Report limits.
TOP_N = 6
TOP_MODALITIES = 5
MIN_MEDIAN_GROUP = 30
LIST_SIZE = 50
SLICE_LABEL_MIN_PCT = 4.0
# Glossary terms tagged in texts (N14), in display order.
GLOSSARY_TERMS = (
    "SECOP II",
    "Entidad",
    "Proveedor",
    "Modalidad de contratación",
    "Contratación directa",
    "Adición de plazo",
    "Pyme",
    "Mediana",
    "Percentil 95",
    "Contrato atípico",
    "Isolation Forest",
)

# Canonical input columns (required) and the one optional column.
REQUIRED_COLUMNS = (
    "entity",
    "contract_id",
    "reference",
    "modality",
    "supplier",
    "is_sme",
    "value",
    "added_days",
    "signed_at",
    "start_at",
    "end_at",
)
OPTIONAL_URL_COLUMN = "process_url"


@dataclass(frozen=True)
class Params:
    """All knobs of the method in one frozen object (part of the snapshot key)."""

    pct_high_value: float = PCT_HIGH_VALUE
    pct_added_days: float = PCT_ADDED_DAYS
    pct_direct_peers: float = PCT_DIRECT_PEERS
    min_entity_contracts: int = MIN_ENTITY_CONTRACTS
    contamination: float = CONTAMINATION
    n_trees: int = N_TREES
    seed: int = SEED
    min_model_rows: int = MIN_MODEL_ROWS
    max_samples: int = MAX_SAMPLES
    band_edges: tuple = field(default=BAND_EDGES)

    def key(self) -> str:
        return repr(self)


DEFAULT = Params()
