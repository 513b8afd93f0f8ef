"""Layer 1: contracts -> enriched snapshot.

Job graph (each arrow a Spark job or a lazy step), all inside a fresh
``attempt-<id>/`` folder that is published at the end:

    contracts --derive (JVM projection)-->
        derived/ [write; pass 1 of the row percentiles observed meanwhile]
    derived --groupBy entity (partial agg)--> entity_stats/             [write]
    derived, entity_stats --exact percentiles (passes 2-4), counts--> thresholds
    derived ⋈ entity_stats (broadcast under a measured bound) --signals,
        features--> usable rows --distinct vectors, pool, per-tree sample-->
        applyInPandas(grow) --> forest/                                 [write]
    rows + forest score, search text (Arrow UDFs) --> rows/ by sign_year
        [write; pass 1 of the 2% score percentile observed meanwhile]
    rows/ --exact 2% percentile of raw scores--> offset --> thresholds/ [write]
    rows/ --trigrams of search_text per file--> grams/                  [write]
    current/ --> this attempt                                  [publish, last]

Thresholds and the model always come from the whole universe; views read
the snapshot and never recompute them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..config import DEFAULT, Params
from ..functions.text import search_text
from ..operators import iforest
from ..operators.derive import band_label, derive
from ..operators.distinct_sets import dense_numbers
from ..operators.quantile import first_pass_aggs, percentile_scalars
from ..operators.signals import add_signals
from ..operators.stats import (Thresholds, THRESHOLD_SCHEMA, compute_thresholds,
                               entity_stats, model_usable, threshold_specs,
                               thresholds_frame, with_entity_stats)
from ..session import ship_package
from ..sources import manifest, search_index
from ..sources import snapshot as store
from ..sources.contracts import (OPTIONAL_URL_COLUMN, REQUIRED_COLUMNS, SOURCE_COLUMN_NAMES,
                                 load_contracts)
from .views import ViewSpec, apply_view

ROW_COLUMNS = (
    "entity", "contract_id", "reference", "modality", "supplier", "is_sme", "value",
    "added_days", "signed_at", "start_at", "end_at", "duration_days", "dates_inverted",
    "is_direct", "value_band", "value_band_label", "sign_year", "search_text", "url",
    "entity_direct_rate", "entity_contracts", "sig_value", "sig_direct", "sig_added",
    "signals", "risk_label", "rule_priority", "model_usable", "anomaly_raw")

#: Derived columns that are made of others: not stored in ``derived/``, not shuffled.
MADE_LATE = ("search_text", "value_band_label")
#: Texts that name one contract.
OWN_TEXTS = ("contract_id", "reference", "url", "search_text")


def _below(raw, offset):
    """Whether a raw score is flagged: a plain comparison, so the scan can prune by it."""
    return F.lit(False) if offset is None else raw.isNotNull() & (raw < F.lit(offset))


@dataclass
class Snapshot:
    key: str
    path: str
    thresholds: Thresholds
    raw_rows: DataFrame
    entity_stats: DataFrame

    @property
    def rows(self) -> DataFrame:
        """Enriched rows with the contamination cut applied (M8)."""
        off = self.thresholds.anomaly_offset
        score = (F.col("anomaly_raw") - F.lit(off).cast("double")) if off is not None \
            else F.lit(None).cast("double")
        return (self.raw_rows
                .withColumn("anomaly_score", F.when(F.col("anomaly_raw").isNotNull(), score))
                .withColumn("is_anomaly", _below(F.col("anomaly_raw"), off)))

    def search(self, query: str | None) -> Snapshot:
        """The snapshot without the files that can't hold all words of a query."""
        spark = self.raw_rows.sparkSession
        return replace(self, raw_rows=search_index.narrowed(
            spark, self.raw_rows, f"{self.path}/rows", f"{self.path}/grams", query))

    def view(self, spec: ViewSpec) -> DataFrame:
        """the rows of a view; its words are looked up in the index."""
        return apply_view(self.search(spec.query).rows, spec)

    def dataset(self) -> DataFrame | None:
        """Origin, files, bytes, rows and fingerprint of what the snapshot was built
        from, and its version; None for a snapshot of a frame."""
        spark = self.raw_rows.sparkSession
        if not store.exists(spark, f"{self.path}/dataset"):
            return None
        return spark.read.parquet(f"{self.path}/dataset")

    def identified(self, figures: DataFrame) -> DataFrame:
        """Figures with the ``dataset_version`` that they were computed from."""
        known = self.dataset()
        version = F.lit(None).cast("string") if known is None else (
            known.agg(F.max("version").alias("v")).scalar())
        return figures.withColumn("dataset_version", version)

    def contract_numbers(self) -> DataFrame:
        """The universe's contracts, numbered; written beside the snapshot when first asked for."""
        spark = self.raw_rows.sparkSession
        base = f"{self.path}/contract_numbers"
        path = store.current_attempt(spark, base)
        if path is None:
            path = f"{base}/attempt-{uuid.uuid4().hex[:12]}"
            store.write_parquet(dense_numbers(self.raw_rows, "contract_id"), path)
            store.publish(spark, base, path)
        return spark.read.schema("contract_id string, number long").parquet(path)

    def forest(self):
        """The fitted forest, or ``None`` when the model was skipped (M4)."""
        from ..sources.snapshot import exists
        spark = self.raw_rows.sparkSession
        if not exists(spark, f"{self.path}/forest"):
            return None
        return iforest.load_forest(spark, f"{self.path}/forest")

    def thresholds_df(self) -> DataFrame:
        return thresholds_frame(self.raw_rows.sparkSession, self.thresholds)


_LOADED: dict[str, Snapshot] = {}


class _Steps:
    """Step timing to stderr when LEDGERLENS_TIMING=1."""

    def __init__(self):
        import os
        import time
        self.on = os.environ.get("LEDGERLENS_TIMING") == "1"
        self.clock = time.time
        self.t = self.clock()

    def __call__(self, name: str) -> None:
        if self.on:
            import sys
            now = self.clock()
            print(f"[ledgerlens] {name}: {now - self.t:.2f}s", file=sys.stderr)
            self.t = now


def build(spark: SparkSession, contracts: DataFrame, key: str, params: Params = DEFAULT,
          dataset: DataFrame | None = None) -> Snapshot:
    """Write a complete snapshot into a fresh attempt folder, then publish it.

    Concurrent or retried builds of the same key never share files: each
    writes its own attempt, and the last one to finish moves the pointer.
    """
    base = store.snapshot_dir(spark, key)
    path = f"{base}/attempt-{uuid.uuid4().hex[:12]}"
    step = _Steps()
    size = 0
    if dataset is not None:
        store.write_parquet(dataset.coalesce(1), f"{path}/dataset")
        size = spark.read.parquet(f"{path}/dataset").agg(F.sum("bytes")).first()[0] or 0
    row_group = store.row_group_bytes(spark, size)
    # The first pass of the threshold percentiles is observed while the
    # derived table is written, saving one full scan.
    seen = Observation("thresholds-pass1")
    derived = derive(contracts).drop(*MADE_LATE)  # made of stored columns, where rows are written
    store.write_parquet(derived.observe(seen, *first_pass_aggs(threshold_specs(params))),
                        f"{path}/derived", row_group=row_group, unlike=OWN_TEXTS)
    step("derive")
    d = spark.read.parquet(f"{path}/derived")
    store.write_parquet(entity_stats(d), f"{path}/entity_stats")
    stats = spark.read.parquet(f"{path}/entity_stats")
    step("entity_stats")
    th = compute_thresholds(d, stats, params, observed=seen.get)
    step("thresholds")

    # Rows of a year are brought together in partitions of even size (hot
    # years are split), else every task would write a file for every year.
    # What is made of other columns is made after that shuffle, the score and
    # the search text in one Python stage.
    dealt = with_entity_stats(d, stats, th.total_entities).hint("rebalance", F.col("sign_year"))
    rows = add_signals(dealt, th, params).withColumn("value_band_label", band_label(F.col("value_band")))
    rows = rows.withColumn("model_usable", model_usable(rows, th.median_duration))
    feat = iforest.features(rows, th.median_duration)
    if th.model_rows >= params.min_model_rows:
        # The model needs derived columns only: read them without the
        # entity lookup join, which Catalyst cannot drop by itself.
        usable = (iforest.features(d, th.median_duration)
                  .where(model_usable(d, th.median_duration)).select(*iforest.FEATURES))
        forest = iforest.fit(usable, th.model_rows, params.n_trees, params.max_samples,
                             params.seed, out_path=f"{path}/forest")
        step("forest")
        score = iforest.score_column(forest, spark)
        raw = F.when(F.col("model_usable"), score(*[F.col(c) for c in iforest.FEATURES]))
    else:  # M4: too few rows, no model
        raw = F.lit(None).cast("double")
    out = feat.select(
        "*", raw.cast("double").alias("anomaly_raw"),
        search_text(F.col("entity"), F.col("supplier"), F.col("reference")).alias("search_text")).select(*ROW_COLUMNS)
    # Likewise the first pass of the contamination offset (M8).
    offset_spec = {"offset": (F.col("anomaly_raw"), params.contamination)}
    seen_raw = Observation("offset-pass1")
    observed = out.observe(seen_raw, *first_pass_aggs(offset_spec))
    store.write_parquet(observed, f"{path}/rows", partition_by=["sign_year"],
                        row_group=row_group, unlike=OWN_TEXTS)
    step("score+rows")

    written = spark.read.parquet(f"{path}/rows")
    offset = None
    if th.model_rows >= params.min_model_rows:
        offset = percentile_scalars(written, offset_spec, first=seen_raw.get)["offset"]
    th = replace(th, anomaly_offset=offset)
    store.write_parquet(thresholds_frame(spark, th).coalesce(1), f"{path}/thresholds")
    step("offset")
    search_index.write_index(spark, f"{path}/rows", "search_text", f"{path}/grams")
    step("index")
    store.publish(spark, base, path)
    store.remove(spark, f"{path}/derived")  # nothing reads it any more
    step("commit")
    return load(spark, key)


def load(spark: SparkSession, key: str) -> Snapshot | None:
    cached = _LOADED.get(key)
    if cached is not None and cached.raw_rows.sparkSession is spark:
        return cached  # same session: reuse; a new session re-reads the tables
    path = store.current_attempt(spark, store.snapshot_dir(spark, key))
    if path is None or not store.exists(spark, f"{path}/thresholds"):
        return None
    t = spark.read.schema(THRESHOLD_SCHEMA).parquet(f"{path}/thresholds").first()
    th = Thresholds(**t.asDict())
    snap = Snapshot(key, path, th, spark.read.parquet(f"{path}/rows"),
                    spark.read.parquet(f"{path}/entity_stats"))
    _LOADED[key] = snap
    return snap


#: Raised by hand when a change alters what a snapshot holds.
METHOD_VERSION = "3"


def get_or_build(spark: SparkSession, contracts_fn, source_paths: list[str],
                 params: Params = DEFAULT, salt: str = "", rebuild: bool = False,
                 columns: Mapping[str, Sequence[str]] | None = None) -> Snapshot:
    """Snapshot for the given inputs; built once, then read by every view.

    The key is the dataset version, so inputs of other content are noticed
    and files that were only written again are not.  ``columns`` names what
    is read of each table.  ``rebuild`` builds and publishes a fresh attempt
    under the same key (the previous attempt stays readable).
    """
    ship_package(spark)
    version = manifest.version_of(spark, source_paths, columns)
    key = store.snapshot_key(version, params.key() + salt, METHOD_VERSION)
    snap = None if rebuild else load(spark, key)
    if snap is None:
        _LOADED.pop(key, None)
        dataset = manifest.dataset_version(manifest.refresh(spark, source_paths, columns))
        snap = build(spark, contracts_fn(), key, params, dataset)
    return snap


def snapshot_of(spark: SparkSession, path: str, version: str | None = None,
                params: Params = DEFAULT) -> Snapshot:
    """Snapshot of a stored contracts table, or of its pinned ``version``.

    The snapshot knows the origin, bytes and fingerprint of the files that it
    was built from, by the columns that are read of them; a pin whose files
    have not changed is not built twice.
    """
    folder = f"{path.rstrip('/')}/{version}" if version else path
    contracts = load_contracts(spark, path, version)
    names = {*SOURCE_COLUMN_NAMES.values(), *REQUIRED_COLUMNS, OPTIONAL_URL_COLUMN}
    read = tuple(c for c in spark.read.parquet(folder).columns if c in names)
    return get_or_build(spark, lambda: contracts, [folder], params, columns={manifest.origin_of(folder): read})


def build_from_frame(contracts: DataFrame, params: Params = DEFAULT) -> Snapshot:
    """Enrich an in-memory or ad-hoc contracts frame under a fresh key."""
    spark = contracts.sparkSession
    ship_package(spark)
    return build(spark, contracts, "adhoc-" + uuid.uuid4().hex[:12], params)
