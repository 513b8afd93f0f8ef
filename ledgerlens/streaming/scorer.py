"""Score new contracts as they arrive, against a fixed snapshot.

The method's rule is that thresholds and the model come from the whole
universe.  Between two snapshot builds (the dataset is refreshed in
batches), newly arriving contracts are scored with the *snapshot's*
thresholds, entity statistics and forest: a stateless map plus a
stream-static lookup join, so no streaming state grows with the data.
The next batch build re-derives everything from the new universe.

Nothing here is a new operator; it applies the snapshot's operators
(derive, J1 lookup, R1-R3, M1-M8 scoring) to a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..operators import iforest
from ..operators.derive import derive
from ..operators.signals import add_signals
from ..operators.stats import model_usable, with_entity_stats
from ..plans.enrich import Snapshot
from ..sources.contracts import select_contract

SCORED_COLUMNS = ("contract_id", "reference", "entity", "modality", "value", "added_days",
                  "duration_days", "sig_value", "sig_direct", "sig_added", "signals",
                  "risk_label", "rule_priority", "anomaly_score", "is_anomaly", "url")


def score_with_snapshot(contracts: DataFrame, snap: Snapshot,
                        params: Params = DEFAULT) -> DataFrame:
    """Batch or streaming contracts -> scored rows, universe fixed by ``snap``."""
    th = snap.thresholds
    rows = add_signals(with_entity_stats(derive(select_contract(contracts)), snap.entity_stats),
                       th, params)
    rows = rows.withColumn("model_usable", model_usable(rows, th.median_duration))
    feat = iforest.features(rows, th.median_duration)
    forest = snap.forest()
    if forest is None or th.anomaly_offset is None:
        score = F.lit(None).cast("double")
    else:
        udf = iforest.score_column(forest, contracts.sparkSession)
        raw = udf(*[F.col(c) for c in iforest.FEATURES])
        score = F.when(F.col("model_usable"), raw - F.lit(th.anomaly_offset))
    return (feat.withColumn("anomaly_score", score)
            .withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") < 0, F.lit(False)))
            .select(*SCORED_COLUMNS))


def start(snap: Snapshot, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
          available_now: bool = False):
    """Watch ``source_dir`` for contract parquet files; append scored rows.

    ``checkpoint_dir`` must be on the shared, fault-tolerant file system
    (e.g. under ``spark.checkpoint.dir``): it makes the query restartable
    after driver or executor loss with exactly-once file output.
    """
    spark = snap.raw_rows.sparkSession
    stream = spark.readStream.schema(schema).parquet(source_dir)
    w = (score_with_snapshot(stream, snap).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
