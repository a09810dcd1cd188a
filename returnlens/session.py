"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A repeated JSON key is legal in the payloads; the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Bounds the bytes of a batch of rows on its way to Python, so that long messages do not pile up there.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # The JIT compiler leaves methods over 8000 bytes of bytecode interpreted; beyond that the
    # projections of the rule chains run faster one by one than fused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings that only count when the session is built. Recording the Python line of every column
# operation multiplies the time it takes to build the classification plan.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session; cluster sizing stays with the caller."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Without one, a cluster gets an error. A local run gets a temporary folder, which is
    remembered in the session so that later calls agree on it.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors reach")
    local = tempfile.mkdtemp(prefix="returnlens-")
    spark.conf.set(CHECKPOINT_KEY, local)
    return local
