"""Descriptive tables and group-difference statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.rows import truthy, weight


def moment_cells(df: DataFrame, keys: Mapping[str, Column],
                 numbers: Mapping[str, Column]) -> DataFrame:
    """Distinct keys with the mergeable moments of every number: count, total, square sum.

    This is the only aggregate that sees rows.  It combines on the map side,
    and what follows works on the distinct combinations of the keys.  Each
    number becomes a struct ``level, n, total, m2`` (``m2``: sum of squared
    distances from the cell's mean); ``_records`` counts the cell's records.
    """
    copies = F.col("_copies")
    rows = df.select(*(c.alias(k) for k, c in keys.items()), weight(df).alias("_copies"),
                     *(c.cast("double").alias(k) for k, c in numbers.items()))
    return rows.groupBy(*keys, "_copies").agg(
        (F.count(F.lit(1)) * copies).alias("_records"),
        *(F.struct(F.lit(None).cast("string").alias("level"), (F.count(c) * copies).alias("n"),
                   (F.sum(c) * copies).alias("total"),
                   (F.var_pop(c) * F.count(c) * copies).alias("m2")).alias(c) for c in numbers))


def _merged_m2(n: Column, total: Column, m2: Column) -> Column:
    """Aggregate: squared distances from the common mean of several cells."""
    apart = F.sum(total * total / n) - F.sum(total) * F.sum(total) / F.sum(n)
    return F.greatest(F.sum(m2) + apart, F.lit(0.0))


def merged(number: str) -> tuple[Column, Column, Column]:
    """Aggregates over cells: count, mean and sample standard deviation of one number."""
    n, total, m2 = (F.when(F.col(f"{number}.n") > 0, F.col(f"{number}.{c}"))
                    for c in ("n", "total", "m2"))
    count = F.coalesce(F.sum(n), F.lit(0).cast("long"))
    spread = _merged_m2(n, total, m2) / (count - 1)
    return count, F.sum(total) / F.sum(n), F.when(count > 1, F.sqrt(spread))


def _level(key: str) -> Column:
    """A category's cell, of the same shape as a number's."""
    none = F.lit(None).cast("double")
    return F.struct(F.col(key).alias("level"), F.col("_records").alias("n"),
                    none.alias("total"), none.alias("m2"))


def _stats(cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``group, variable, level, n, total, m2`` from cells with a struct column per variable.

    One row per group and number, and per group, category and level.
    """
    long = cells.unpivot("_group", list(variables), "variable", "_cell") \
        .select(F.col("_group").alias("group"), "variable", "_cell.*") \
        .where("n > 0 AND (level IS NOT NULL OR total IS NOT NULL)")
    return long.groupBy("group", "variable", "level").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        _merged_m2(F.col("n"), F.col("total"), F.col("m2")).alias("m2"))


def group_stats(df: DataFrame, by: str, numeric: Sequence[str],
                categorical: Sequence[str]) -> DataFrame:
    """``_stats`` of a frame whose column ``by`` names each row's group."""
    levels = {f"_level_{i}": F.col(c).cast("string") for i, c in enumerate(categorical)}
    numbers = {f"_number_{i}": F.col(c) for i, c in enumerate(numeric)}
    cells = moment_cells(df, {"_group": F.col(by), **levels}, numbers)
    return _stats(cells.select(
        "_group", *(F.col(k).alias(c) for k, c in zip(numbers, numeric, strict=True)),
        *(_level(k).alias(c) for k, c in zip(levels, categorical, strict=True))),
        [*numeric, *categorical])


@dataclass(frozen=True)
class Group:
    """People who meet a condition; ``numbers`` replaces variables that differ by group."""

    label: str
    condition: Column
    numbers: Mapping[str, Column | None]


def overlapping_stats(df: DataFrame, groups: Sequence[Group], numeric: Sequence[str],
                      categorical: Sequence[str]) -> DataFrame:
    """``_stats`` of groups that share people, from one aggregate over the people.

    People fall into cells by the groups they belong to and their categories.
    Cells, not people, are then given to each of their groups.
    """
    belongs = {f"_in_{i}": truthy(g.condition) for i, g in enumerate(groups)}
    levels = {f"_level_{i}": F.col(c).cast("string") for i, c in enumerate(categorical)}
    numbers = {f"_number_{c}": F.col(c) for c in numeric
               if any(c not in g.numbers for g in groups)}
    numbers |= {f"_number_{i}_{c}": x for i, g in enumerate(groups)
                for c, x in g.numbers.items() if x is not None}
    cells = moment_cells(df, {**belongs, **levels}, numbers)
    nothing = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (
        ("level", "string"), ("n", "long"), ("total", "double"), ("m2", "double"))))

    def number(i: int, g: Group, c: str) -> Column:
        if c not in g.numbers:
            return F.col(f"_number_{c}")
        return nothing if g.numbers[c] is None else F.col(f"_number_{i}_{c}")

    rows = [F.when(F.col(f"_in_{i}"), F.struct(
        F.lit(g.label).alias("_group"), *(number(i, g, c).alias(c) for c in numeric),
        *(_level(k).alias(c) for k, c in zip(levels, categorical, strict=True))))
        for i, g in enumerate(groups)]
    shared = cells.select(F.explode(F.array(*rows)).alias("_row")).where("_row IS NOT NULL")
    return _stats(shared.select("_row.*"), [*numeric, *categorical])


def described(stats: DataFrame, hide_level: str | None = None, digits: int = 4) -> DataFrame:
    """Counts, percentages, means and standard deviations from ``_stats``."""
    n, total, m2 = F.col("n"), F.col("total"), F.col("m2")
    # one row per level from here on
    known = F.sum("n").over(Window.partitionBy("group", "variable"))
    out = stats.select(
        "group", "variable", "level", "n",
        F.when(F.col("level").isNotNull(), F.round(100 * n / known, digits)).alias("pct"),
        F.round(total / n, digits).alias("mean"),
        F.when(total.isNotNull() & (n > 1), F.round(F.sqrt(m2 / (n - 1)), digits)).alias("sd"))
    if hide_level is not None:
        out = out.where(~truthy(F.col("level") == hide_level))
    return out


def describe(df: DataFrame, by: str, numeric: Sequence[str], categorical: Sequence[str],
             hide_level: str | None = None, digits: int = 4) -> DataFrame:
    """Stratified description, one row per group, variable and level.

    Categories get ``n`` and ``pct`` of the group's known values; numbers get
    ``mean``, ``sd`` and ``n``.  ``hide_level`` is left out after percentages
    are taken.
    """
    return described(group_stats(df, by, numeric, categorical), hide_level, digits)


def with_order(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Add ``<column>_order``, the rank of each label in the given order."""
    position = F.array_position(F.array(*(F.lit(v) for v in levels)), F.col(column))
    return df.withColumn(f"{column}_order", position.cast("int"))


def mean_sd_text(df: DataFrame, digits: int = 1) -> DataFrame:
    """``mean (sd), n`` as text for a report; a single value has ``NA`` for its sd."""
    def number(column: str) -> Column:
        return F.when(F.col(column).isNull(), "NA").otherwise(
            F.format_string(f"%.{digits}f", column))

    shown = F.concat(number("mean"), F.lit(" ("), number("sd"), F.lit("), "), F.col("n"))
    return df.withColumn("shown", shown)


def group_tests(df: DataFrame, by: str, numeric: Sequence[str], categorical: Sequence[str],
                digits: int = 4) -> DataFrame:
    """Group-difference statistics: ``variable, test, statistic, df1, df2``.

    Pearson chi-squared for categories and the one-way analysis-of-variance F
    for numbers, both from one aggregate of counts, totals and square sums.
    """
    stats = group_stats(df, by, numeric, categorical)

    def total(column: str, *keys: str) -> Column:
        return F.sum(column).over(Window.partitionBy("variable", *keys))

    def first(*keys: str, order: str) -> Column:
        return F.row_number().over(Window.partitionBy("variable", *keys).orderBy(order)) == 1

    # all windows and the last aggregate run on one partitioning, by variable
    table = (
        stats.withColumns({"all": total("n"), "grand": total("total")})
        .withColumns({"row": total("n", "group"), "new_group": first("group", order="level")})
        .withColumns({"col": total("n", "level"), "new_level": first("level", order="group")})
    )
    n, mean, grand = F.col("n"), F.col("total") / F.col("n"), F.col("grand") / F.col("all")
    is_level = F.max(F.col("level").isNotNull())
    groups, levels = F.count_if("new_group"), F.count_if("new_level")
    # sum((o-e)^2/e) = N * (sum(o^2 / (row*col)) - 1), so empty cells need no rows
    chi = F.max("all") * (F.sum(n * n / (F.col("row") * F.col("col"))) - 1)
    df2 = F.max("all") - groups
    between, within = F.sum(n * F.pow(mean - grand, F.lit(2))), F.sum("m2")
    ratio = F.try_divide(F.try_divide(between, groups - 1), F.try_divide(within, df2))
    return table.groupBy("variable").agg(
        F.when(is_level, "chi-squared").otherwise("F").alias("test"),
        F.round(F.when(is_level, chi).otherwise(ratio), digits).alias("statistic"),
        F.when(is_level, (groups - 1) * (levels - 1)).otherwise(groups - 1).alias("df1"),
        F.when(~is_level, df2).alias("df2"))


# Groups of the first comparison table.
TABLE_ONE_GROUPS: Mapping[str, str] = {
    "population": "All Population",
    "extra_only": "Extra Codes Only",
    "register": "Register In Population",
    "cases": "Cases",
}
