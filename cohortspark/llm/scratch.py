"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders made here, by application


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a folder of this machine is made, if all of Spark runs on it (as in tests).
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {SETTING}, a folder that all machines share")
        run = spark.sparkContext.applicationId
        if run not in _own:
            _own[run] = "file://" + tempfile.mkdtemp(prefix="llm-")
        folder = _own[run]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs only its own tasks. Like a
    checkpoint, the table stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark deletes the shuffle files of finished jobs when the driver collects its garbage;
    # a long chain of stored tables would else hold the files of all of them on the executors' disks
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
