"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Spark chooses join sides and partition counts from measured sizes at run time;
# nothing in the library forces a broadcast of data that can grow.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # call-site capture costs several milliseconds per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # filters are built from code lists over tables whose size Spark can only guess from above
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.files.maxPartitionBytes": "128m",
    # a bucket stored as one sorted file is read as sorted
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def build_session(app: str = "cohortspark", **overrides: str) -> SparkSession:
    """A session with the library's settings; ``overrides`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
