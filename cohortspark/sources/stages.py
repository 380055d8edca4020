"""Stored stages: build once, reuse afterwards, and cut long lineages.

A stage is a Parquet table in shared storage, so it outlives lost executors.
Stages of people are bucketed and sorted by person and known to the catalog,
so joins and aggregates by person start from them without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from copy import copy

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints."""
    return spark.conf.get("spark.checkpoint.dir", None)


def input_identity(tables: Mapping[str, DataFrame]) -> list[tuple]:
    """What tells one set of inputs from another: names, schemas and files.

    A frame without files is told by its plan.
    """
    return [(name, df.schema.simpleString(), sorted(df.inputFiles()) or df.semanticHash())
            for name, df in sorted(tables.items())]


class StageStore:
    """Named Parquet stages under one run folder.

    Frames with the column ``key`` are stored in ``buckets`` buckets (the
    session's shuffle partitions, if not given), one sorted file each.  The
    layout is part of the folder, so stages of another layout are never taken
    for this store's.
    """

    def __init__(self, spark: SparkSession, run: str, buckets: int | None = None,
                 key: str = "person_id", folder: str | None = None) -> None:
        folder = folder or shared_folder(spark)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir, a folder that all machines share")
        self.spark, self.key = spark, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{folder.rstrip('/')}/{run}/{key}-{self.buckets}"

    def keyed(self, *parts: object) -> StageStore:
        """The stages of what ``parts`` describe, apart from those of anything else."""
        store = copy(self)
        store.root = f"{self.root}/{hashlib.sha256(repr(parts).encode()).hexdigest()[:16]}"
        return store

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> str:
        """The stage's name in the catalog, unlike that of any other folder's stage."""
        return f"stage_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{name}"

    def has(self, name: str) -> bool:
        """Only a stage whose write was committed counts."""
        jvm = self.spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        conf = self.spark._jsc.hadoopConfiguration()
        return marker.getFileSystem(conf).exists(marker)

    def run(self, name: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        """Stored result of ``build``, computed when absent or when ``refresh`` is set."""
        if refresh or not self.has(name):
            self._write(name, build())
        return self._read(name, build)

    def _write(self, name: str, df: DataFrame) -> None:
        if self.key in df.columns:
            # rows are dealt as the buckets are, so each bucket becomes one file
            create_table(df.repartition(self.buckets, self.key), self.table(name),
                         buckets=self.buckets, bucket_by=self.key, path=self.path(name))
        else:
            df.write.mode("overwrite").parquet(self.path(name))

    def _read(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.spark.catalog.tableExists(self.table(name)):
            try:
                schema = self.spark.read.parquet(self.path(name)).schema
            except AnalysisException:  # an empty bucketed stage has no file to tell its schema
                schema = build().schema
            if self.key not in schema.names:
                return self.spark.read.schema(schema).parquet(self.path(name))
            # written by an earlier session whose catalog is gone: the files and layout are known
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE {self.table(name)} ({columns}) USING parquet "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.path(name)}'")
        return self.spark.table(self.table(name))


def create_table(df: DataFrame, name: str, *, buckets: int | None = None,
                 bucket_by: str = "person_id", partition_by: str | None = None,
                 path: str | None = None) -> DataFrame:
    """Create or replace a catalog table; with ``path``, one whose files lie there.

    Bucketing event and person tables on the person id lets every later
    person-keyed join and aggregate skip its shuffle of that table.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
