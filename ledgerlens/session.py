"""Session defaults and the shared work folder.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared,
fault-tolerant file system).  Only when that is unset -- local runs and
tests -- do we create one ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on; they are applied on the session, never
# baked into a query.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where an aggregate by the join's key follows (percentiles of groups):
    # a hot group is split at the price of one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str = "local[8]", app: str = "ledgerlens",
                shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL options we depend on (idempotent)."""
    for k, v in RECOMMENDED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an existing session: leave it
            pass


def work_dir(spark: SparkSession) -> str:
    """Shared folder for snapshots and lineage cuts.

    Reads ``spark.checkpoint.dir``; sets a local one only when unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the shared checkpoint folder (survives lost executors)."""
    work_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table of the shared folder, for what several passes read.

    Unlike ``cut`` its readers take only the columns and rows that they need;
    it stays in the folder.
    """
    path = f"{work_dir(df.sparkSession)}/ledgerlens/work/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable in Python workers (like ``--py-files``).

    Done once per SparkContext: the package is zipped on the driver and
    distributed by Spark's file server to every executor.
    """
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="ledgerlens-pyfiles-")
    zpath = os.path.join(out_dir, "ledgerlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
