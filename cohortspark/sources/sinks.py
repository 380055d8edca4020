"""Size guards and report output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: largest extract that is handed on without asking.
ROW_BUDGET = 900_000


class RowBudgetExceeded(RuntimeError):
    """An extract meant for a single machine is larger than allowed."""


def event_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("event_count"))


def within_budget(df: DataFrame, max_rows: int = ROW_BUDGET) -> DataFrame:
    """``event_count`` with a 0/1 verdict against the budget."""
    return event_count(df).withColumn(
        "within_budget", (F.col("event_count") <= max_rows).cast("int"))


def guarded(df: DataFrame, max_rows: int = ROW_BUDGET) -> DataFrame:
    """``df`` itself, or an error before anything large leaves the cluster.

    Counting stops one row above the budget.
    """
    if event_count(df.limit(max_rows + 1)).first()["event_count"] > max_rows:
        raise RowBudgetExceeded(f"more than {max_rows} rows")
    return df


def write_report(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """A folder of CSV files with headers, of any size unless the caller sets a budget."""
    checked = df if max_rows is None else guarded(df, max_rows)
    checked.write.mode("overwrite").option("header", True).csv(path)
