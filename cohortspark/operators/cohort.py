"""The case rule and the cohorts built from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.codes import COUNTED_CONCEPTS
from cohortspark.config import StudyConfig
from cohortspark.functions.dates import years_between
from cohortspark.functions.labels import age_bracket
from cohortspark.functions.rows import flag
from cohortspark.operators.events import SOURCES

# Labels of results.
LONG_GAP = "Over 6 Months From Earliest GP Entry"
MANY_EVENTS = "3 or More Events"
GRAND_TOTAL = "Grand Total (All MS)"


def _long_gap(cfg: StudyConfig) -> Column:
    return F.datediff("potential_date", "first_contact") >= cfg.min_gap_days


def _many_events(cfg: StudyConfig) -> Column:
    return F.col("core_count") >= cfg.min_events


def classify_cases(population: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Add ``is_case``: a core event, and onset long after first contact or enough core events."""
    rule = F.col("core_date").isNotNull() & (_long_gap(cfg) | _many_events(cfg))
    return population.withColumn("is_case", flag(rule))


def case_cohort(classified: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Cases with the reason they qualify, time to trigger and age bracket at onset."""
    trigger = years_between(F.col("core_event_3_date"), F.col("potential_date"))
    return (
        classified.where("is_case = 1")
        .withColumn("reason", F.when(_long_gap(cfg), LONG_GAP)
                    .when(_many_events(cfg), MANY_EVENTS))
        .withColumn("time_to_trigger", F.when(F.col("reason") != LONG_GAP, trigger))
        .withColumnsRenamed({"potential_year": "diagnosis_year",
                             "potential_age": "diagnosis_age"})
        .withColumn("diagnosis_bracket", age_bracket(F.col("diagnosis_age")))
    )


def extra_only(classified: DataFrame) -> DataFrame:
    """People without a core event who have some other onset."""
    return classified.where("core_date IS NULL AND potential_date IS NOT NULL") \
        .withColumnRenamed("potential_age", "diagnosis_age")


def code_totals(people: DataFrame, populations: Mapping[str, str],
                without_total: Sequence[str] = ()) -> DataFrame:
    """People per code type and population: ``population, code_type, people``.

    ``people`` has one row per person with the event counts and a boolean column
    per population; ``populations`` gives each column its label.  A person counts once per
    type; types nobody has are left out.  The grand total is the number of
    people with any type, 0 included, not the sum of the parts.  All numbers come from one global aggregate, whose single row
    is then unpivoted, so no person row is ever multiplied.
    """
    each = {c: " + ".join(f"{c}_{s.lower()}_count" for s in SOURCES) for c in COUNTED_CONCEPTS}
    each[GRAND_TOTAL] = " + ".join(each.values())
    cells = [(column, label, kind) for column, label in populations.items() for kind in each
             if kind != GRAND_TOTAL or column not in without_total]
    totals = people.agg(*(
        F.expr(f"sum(least({each[kind]}, 1)) FILTER (WHERE {column})").alias(f"_{i}")
        for i, (column, _, kind) in enumerate(cells)))
    rows = ", ".join(
        f"named_struct('population', '{label}', 'code_type', '{kind}', 'people', _{i})"
        for i, (_, label, kind) in enumerate(cells))
    return totals.selectExpr(f"inline(array({rows}))").where(
        (F.col("people") > 0) | (F.col("code_type") == GRAND_TOTAL)) \
        .withColumn("people", F.coalesce("people", F.lit(0).cast("long")))
