"""Pruned, contract-checked scan of a contracts parquet.

* S1  only the required columns plus the optional URL column are read;
      Catalyst prunes the parquet ``ReadSchema`` to them.
* S2  every missing required column is reported in one error, raised from
      the schema alone, before any data is read.
* S3  the optional URL column becomes a typed null column when absent.
* S4  ``version`` pins a dataset version (a sub-folder of the dataset root)
      so that published figures can be reproduced; ``None`` follows the
      latest data at ``path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OPTIONAL_URL_COLUMN, REQUIRED_COLUMNS

# FIXED: column names of the public source dataset, mapped to our names.
SOURCE_COLUMN_NAMES = {
    "entity": "Nombre Entidad",
    "contract_id": "ID Contrato",
    "reference": "Referencia del Contrato",
    "modality": "Modalidad de Contratacion",
    "supplier": "Proveedor Adjudicado",
    "is_sme": "Es Pyme",
    "value": "Valor del Contrato",
    "added_days": "Dias adicionados",
    "signed_at": "Fecha de Firma",
    "start_at": "Fecha de Inicio del Contrato",
    "end_at": "Fecha de Fin del Contrato",
    "process_url": "urlproceso",
}


class DataContractError(RuntimeError):
    """The input cannot be read or lacks the expected shape."""


def select_contract(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Check the contract on ``df``'s schema and project it to canonical names."""
    names = names or {c: c for c in (*REQUIRED_COLUMNS, OPTIONAL_URL_COLUMN)}
    present = set(df.columns)
    missing = [names.get(c, c) for c in REQUIRED_COLUMNS if names.get(c, c) not in present]
    if missing:
        raise DataContractError(
            "input lacks required columns: " + ", ".join(repr(c) for c in missing))
    cols = [F.col(f"`{names.get(c, c)}`").alias(c) for c in REQUIRED_COLUMNS]
    url_src = names.get(OPTIONAL_URL_COLUMN, OPTIONAL_URL_COLUMN)
    if url_src in present:
        cols.append(F.col(f"`{url_src}`").alias(OPTIONAL_URL_COLUMN))
    else:
        cols.append(F.lit(None).cast("string").alias(OPTIONAL_URL_COLUMN))
    return df.select(*cols)


def load_contracts(spark: SparkSession, path: str, version: str | None = None,
                   names: dict[str, str] | None = None) -> DataFrame:
    """Lazy, pruned scan of a contracts parquet dataset.

    ``names`` maps canonical names to the file's column names; by default
    the source dataset's own names are tried first, then canonical names.
    """
    target = f"{path.rstrip('/')}/{version}" if version else path
    try:
        raw = spark.read.parquet(target)
    except Exception as e:  # unreadable or absent: one typed error
        raise DataContractError(f"cannot read parquet at {target!r}: {e}") from e
    if names is None:
        present = set(raw.columns)  # the set of names that the file has more of
        if (len(present.intersection(SOURCE_COLUMN_NAMES.values()))
                > len(present.intersection(REQUIRED_COLUMNS))):
            names = SOURCE_COLUMN_NAMES
    return select_contract(raw, names)
