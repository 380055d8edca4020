"""First, nth and last events, and the one-row-per-person feature frame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cohortspark.codes import CORE, COUNTED_CONCEPTS, EXTRA, FAMILY_HISTORY, NMO
from cohortspark.config import StudyConfig
from cohortspark.operators.events import SOURCES
from cohortspark.operators.identity import trusted

NTH_EVENTS = (3, 7)
POTENTIAL_CONCEPTS = (CORE, EXTRA, NMO)


def first_contact(events: DataFrame, cfg: StudyConfig) -> DataFrame:
    """First trusted record per person from one year before the study, not before birth."""
    return (
        events.where(F.col("person_id").isNotNull() & trusted(links=cfg.trusted_links)
                     & (F.col("event_date") >= F.col("birth_date"))
                     & F.col("event_date").between(F.lit(date(cfg.year_min - 1, 1, 1)),
                                                   F.lit(cfg.date_max)))
        .groupBy("person_id").agg(F.min("event_date").alias("first_contact"))
    )


def span(events: DataFrame, date_column: str, key: str = "person_id") -> DataFrame:
    """First and last date per person, in one pass."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(date_column).alias("first_date"), F.max(date_column).alias("last_date"))


def first_event(events: DataFrame) -> DataFrame:
    """Earliest valid event per person; the age follows from the date."""
    return events.groupBy("person_id").agg(
        F.min("event_date").alias("first_date"), F.min("event_age").alias("first_age"))


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("person_id").agg(F.max("event_date").alias("last_date"))


def _weight(events: DataFrame) -> Column:
    """How many distinct death dates a row stands for; 1 where rows are repeated per date."""
    return F.col("dates") if "dates" in events.columns else F.lit(1).cast("long")


def _in_order(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("event_date", "source")


def _reached(weight: Column, order: WindowSpec) -> Column:
    """Events of the group up to and with this row, counted by weight."""
    return F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def nth_event(events: DataFrame, n: int) -> DataFrame:
    """Date of each person's nth distinct event.

    Rows are made distinct first, so a person holds at most one row per day
    and source.  Each counts for at least one event, so a rank limit of n rows
    applies ahead of the shuffle.
    """
    weight = _weight(events)
    order = _in_order("person_id")
    deaths = [c for c in ("dates", "death_date") if c in events.columns]
    distinct = events.select("person_id", "event_date", "source", *deaths).distinct()
    return (
        distinct.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        .withColumn("_reached", _reached(weight, order))
        .where((F.col("_reached") >= n) & (F.col("_reached") - weight < n))
        .select("person_id", F.col("event_date").alias("nth_date"))
    )


def person_features(events: DataFrame) -> DataFrame:
    """Onsets, nth and last dates and counts per person, from valid events of all concepts.

    One shuffle on the person serves the running counts and all aggregates.
    Input rows are distinct per person, day, source, concept and code, which
    bounds the rows a single person can bring to a task.
    """
    potential = ", ".join(f"'{c}'" for c in POTENTIAL_CONCEPTS)
    core, nmo, history = (f"concept = '{c}'" for c in (CORE, NMO, FAMILY_HISTORY))
    onset = f"concept IN ({potential})"
    features = {
        "core_date": f"min(event_date) FILTER (WHERE {core})",
        "core_age": f"min(event_age) FILTER (WHERE {core})",
        **{f"core_event_{n}_date": f"min(event_date) FILTER (WHERE {core} AND _reached >= {n})"
           for n in NTH_EVENTS},
        "potential_date": f"min(event_date) FILTER (WHERE {onset})",
        "potential_age": f"min(event_age) FILTER (WHERE {onset})",
        "nmo_date": f"min(event_date) FILTER (WHERE {nmo})",
        "nmo_age": f"min(event_age) FILTER (WHERE {nmo})",
        "nmo_last_date": f"max(event_date) FILTER (WHERE {nmo})",
        "family_history_date": f"min(event_date) FILTER (WHERE {history})",
        "family_history_age": f"min(event_age) FILTER (WHERE {history})",
        **{f"{name}_{source.lower()}_count":
           f"coalesce(sum(copies) FILTER (WHERE concept = '{name}' AND source = '{source}'), 0)"
           for name in COUNTED_CONCEPTS for source in SOURCES},
    }
    counted = events.withColumn("_reached", _reached(_weight(events),
                                                     _in_order("person_id", "concept")))
    return counted.groupBy("person_id").agg(*(F.expr(e).alias(n) for n, e in features.items()))
