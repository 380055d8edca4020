"""Row-level building blocks that stay safe when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truthy(condition: Column) -> Column:
    """Three-valued condition with null counted as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 column; null counts as 0."""
    return truthy(condition).cast("int")


def top_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; columns not named in ``order`` break ties.

    Spark plans ``row_number() = 1`` with a per-task group limit ahead of the
    shuffle, so a hot key sends at most one row per map task.
    """
    ties = [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def many_values(column: str) -> Column:
    """Aggregate: more than one distinct value in the group, null counted as a value.

    Built from min, max and counts, which combine on the map side, instead of a
    distinct count, which would shuffle every value.
    """
    c = F.col(column)
    known = F.count(c)
    return truthy(F.min(c) != F.max(c)) | ((known > 0) & (known < F.count(F.lit(1))))


def single_row_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows of keys that have exactly one distinct row."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    grouped = df.groupBy(key).agg(
        *(F.max(c).alias(c) for c in rest),
        *(many_values(c).alias(f"_many_{c}") for c in rest),
    )
    clash = [f"_many_{c}" for c in rest]
    return grouped.where(~F.greatest(*(F.col(c) for c in clash), F.lit(False))).select(df.columns)


def repeat_rows(df: DataFrame, copies: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``copies`` times, without the column.

    Two nested sequences keep the arrays short even for a huge count.
    """
    n = F.col(copies)
    rest = F.least(F.lit(chunk), n - F.col("_chunk") * chunk)
    return (
        df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk))))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), rest)))
        .drop("_chunk", "_copy", copies)
    )


def in_set(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def not_in_set(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``ids``; rows with a null key are kept
    unless ``ids`` has a null too."""
    return df.join(ids.select(F.col(key).alias("_id")), F.col(key).eqNullSafe(F.col("_id")),
                   "left_anti")


def union_ids(frames: Iterable[DataFrame], key: str) -> DataFrame:
    """Distinct keys over several frames."""
    frames = [f.select(key) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def weight(df: DataFrame) -> Column:
    """How many records a row stands for: its ``copies``, or 1 where rows are records."""
    return F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")


def count_records(df: DataFrame, condition: Column | None = None) -> Column:
    """Aggregate: number of records, or of those that meet a condition."""
    counted = weight(df) if condition is None else F.when(condition, weight(df))
    return F.coalesce(F.sum(counted), F.lit(0).cast("long"))


def records(df: DataFrame) -> DataFrame:
    """A row per record, without ``copies``."""
    return repeat_rows(df, "copies") if "copies" in df.columns else df


# Hash ranges whose fingerprints are compared; the frames meet row by row only in those that differ.
RANGES = 4096


def fingerprints(rows: DataFrame, columns: Sequence[str], left: Column, right: Column) -> DataFrame:
    """Per range of row hashes: rows of either side and the difference of two hash sums.

    Sums do not depend on order and combine on the map side, so at most
    ``RANGES`` rows per task are shuffled.  Two sides with the same rows have
    no difference; two with other rows have one, but for a chance of about
    2^-64 in each range.
    """
    return rows.select(
        F.pmod(F.xxhash64(*columns), F.lit(RANGES)).alias("_range"), left.alias("_left"),
        right.alias("_right"), F.shiftright(F.xxhash64(*columns), 32).alias("_first"),
        F.hash(*columns).cast("long").alias("_second"),
    ).groupBy("_range").agg(
        F.sum("_left").alias("left_rows"), F.sum("_right").alias("right_rows"),
        *(F.sum((F.col("_left") - F.col("_right")) * F.col(c)).alias(c)
          for c in ("_first", "_second")))


def _differing(prints: DataFrame) -> DataFrame:
    return prints.where("left_rows <> right_rows OR _first <> 0 OR _second <> 0")


def differing_rows(rows: DataFrame, columns: Sequence[str], left: Column, right: Column,
                   prints: DataFrame) -> DataFrame:
    """Rows of the ranges whose fingerprints differ, with their number on either side."""
    suspect = F.broadcast(_differing(prints).select("_range"))  # at most RANGES rows
    sides = rows.select(*columns, left.alias("left_rows"), right.alias("right_rows"))
    return (
        sides.withColumn("_range", F.pmod(F.xxhash64(*columns), F.lit(RANGES)))
        .join(suspect, "_range", "left_semi").groupBy(*columns)
        .agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
        .where("left_rows <> right_rows")
    )


def compare_subsets(rows: DataFrame, columns: Sequence[str], left: Column,
                    right: Column) -> DataFrame:
    """One row: size of two multisets and number of distinct rows that differ.

    ``left`` and ``right`` say how often each row of ``rows`` belongs to either
    side.  One pass takes the fingerprints, a table of at most ``RANGES`` rows
    that is kept; rows are read again, and shuffled, only if some differ.
    """
    prints = fingerprints(rows, columns, left, right).persist()
    sizes = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
             for c in ("left_rows", "right_rows")]
    none = F.lit(0).cast("long")
    if _differing(prints).isEmpty():
        return prints.agg(*sizes, none.alias("differing_rows"))
    found = differing_rows(rows, columns, left, right, prints)
    counted = prints.select("left_rows", "right_rows", none.alias("differing_rows")).unionByName(
        found.select(none.alias("left_rows"), none.alias("right_rows"),
                     F.lit(1).cast("long").alias("differing_rows")))
    return counted.agg(*sizes, F.sum("differing_rows").alias("differing_rows"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[str], Column, Column]:
    """Both frames in one, and the side of each row as two 0/1 columns."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    return both, a.columns, *((F.col("_side") == side).cast("long") for side in (1, 2))


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that occur a different number of times in the two frames."""
    sides = _sides(a, b)
    return differing_rows(*sides, fingerprints(*sides))


def compare_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: size of either frame and number of distinct rows that differ."""
    return compare_subsets(*_sides(a, b))


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same columns and the same rows the same number of times."""
    return sorted(a.columns) == sorted(b.columns) and frame_difference(a, b).isEmpty()
