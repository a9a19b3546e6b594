"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Arrow batches for Python: by bytes, as a batch of 10,000 long texts or arrays takes a hundred
# times that once it is Python's objects.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

# Nothing here is required: every batch operator runs on a plain session (the
# rate-limit stream needs the state store named here). AQE is what sizes
# shuffle partitions, turns measured-small join sides into broadcasts and splits skewed
# join partitions, so it should stay on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    BATCH_BYTES[0]: BATCH_BYTES[1],
}


def build_session(
    app_name: str = "corpusflow", master: str | None = None, **overrides: str
) -> SparkSession:
    """Get or create a session; ``overrides`` use ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in overrides.items():
        builder = builder.config(name.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application.

    Arrow batches are bounded to ``BATCH_BYTES`` unless the application has set a bound.
    """
    context = spark.sparkContext
    if not getattr(spark, "_corpusflow_bounded", False):
        if context.getConf().get(BATCH_BYTES[0]) is None:
            spark.conf.set(*BATCH_BYTES)
        spark._corpusflow_bounded = True
    if not getattr(context, "_corpusflow_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corpusflow-")) / "corpusflow.zip"
        with zipfile.ZipFile(archive, "w") as package:
            for source in sorted(root.rglob("*.py")):
                package.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._corpusflow_shipped = True
    return spark
