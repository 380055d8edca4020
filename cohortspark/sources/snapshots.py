"""Which stored snapshot of a dataset a study reads.

A dataset is stored once per extract, as ``name_YYYYMMDD`` in a catalog
database or below a folder.  A study names the date it looks back from, and
each dataset is read from its latest snapshot that is not after that date.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from cohortspark.config import StudyConfig

STAMP = re.compile(r"_([0-9]{8})$")


class NoSnapshot(LookupError):
    """A dataset has snapshots, but none that is old enough."""


def stored_names(spark: SparkSession, cfg: StudyConfig, name: str) -> list[str]:
    """Names of the tables or folders that may be snapshots of a dataset."""
    if "/" in cfg.namespace:
        jvm = spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{cfg.namespace}{name}_*")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return [s.getPath().getName() for s in found or ()]
    database = cfg.namespace.rstrip(".") or None
    return [t.name for t in spark.catalog.listTables(database, f"{name}_*")]


def stamps(names: Iterable[str], name: str) -> list[str]:
    """Stamps of a dataset's snapshots, oldest first; other names are passed over."""
    return sorted(m[1] for n in names if (m := STAMP.search(n)) and n[:m.start()] == name)


def latest_stamp(spark: SparkSession, cfg: StudyConfig, name: str) -> str | None:
    """Stamp of the latest snapshot not after ``cfg.as_of``; none for a dataset without snapshots."""
    known = stamps(stored_names(spark, cfg, name), name)
    usable = [s for s in known if s <= cfg.as_of]
    if known and not usable:
        raise NoSnapshot(f"{name}: no snapshot by {cfg.as_of}, only {', '.join(known)}")
    return usable[-1] if usable else None
