"""Deaths from several sources, most reliable source first."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.codes import DEATH_CODE_PATTERNS, DEATH_DISCHARGE_METHOD
from cohortspark.config import StudyConfig
from cohortspark.functions.rows import repeat_rows

REGISTER, DEMOGRAPHICS, GP_RECORD, HOSPITAL = "REGISTER", "DEMOGRAPHICS", "GP", "HOSPITAL"


@dataclass(frozen=True)
class DeathSource:
    """``rows`` has ``person_id, death_date``; ``first_only`` keeps the earliest per person."""

    name: str
    rows: DataFrame
    first_only: bool = False


def code_dictionary(dictionary_a: DataFrame, dictionary_b: DataFrame) -> DataFrame:
    """Codes and descriptions of both dictionaries, each pair once."""
    return dictionary_a.select("code", "description").unionByName(
        dictionary_b.select(
            "code", F.coalesce("long_term", "short_term").alias("description"))
    ).distinct()


def discover_codes(dictionary: DataFrame,
                   patterns: Sequence[str] = DEATH_CODE_PATTERNS) -> DataFrame:
    """Dictionary entries whose code matches one of the patterns."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("code").rlike(p)
    return dictionary.where(hit)


def death_codes(dictionary_a: DataFrame, dictionary_b: DataFrame,
                patterns: Sequence[str] = DEATH_CODE_PATTERNS) -> DataFrame:
    """Matching codes of both dictionaries, as the right side of a semi-join: repeats do no harm."""
    return discover_codes(dictionary_a.select("code").unionByName(dictionary_b.select("code")),
                          patterns)


def literal_prefixes(patterns: Sequence[str]) -> list[str]:
    """What the matches of each pattern start with; none if one pattern leaves it open."""
    found = []
    for p in patterns:
        start = re.match(r"\^([0-9A-Za-z]+)(.?)", p)
        fixed = start and (start[1][:-1] if start[2] in tuple("?*{") else start[1])
        if not fixed or "|" in p:
            return []
        found.append(fixed)
    return found


def gp_deaths(events: DataFrame, codes: DataFrame, cfg: StudyConfig,
              prefixes: Sequence[str] = ()) -> DataFrame:
    """GP events that record a death.

    The code list comes from data, so it is semi-joined and Spark picks the
    join from its measured size.  ``prefixes``, if given, start every code of
    the list and reach the scan.
    """
    if prefixes:
        start = F.lit(False)
        for p in prefixes:
            start = start | F.col("code").startswith(p)
        events = events.where(start)
    usable = events.where(F.col("person_id").isNotNull()
                          & (F.col("event_date") >= F.col("birth_date"))
                          & (F.col("event_date") <= F.lit(cfg.date_max)))
    return usable.join(codes.select("code"), "code", "left_semi").select(
        "person_id", F.col("event_date").alias("death_date"))


def hospital_deaths(spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Stays that ended in death by the end of the study."""
    return spells.where(
        F.col("person_id").isNotNull()
        & (F.col("discharge_method") == DEATH_DISCHARGE_METHOD)
        & (F.col("discharge_date") <= F.lit(cfg.date_max))
    ).select("person_id", F.col("discharge_date").alias("death_date"))


def death_cascade(sources: Sequence[DeathSource], dedupe: bool = False) -> DataFrame:
    """Each person's deaths from the first source that lists the person.

    One row per person and death date: ``person_id, death_date, death_source,
    copies``, where ``copies`` counts the records with that date.  All sources
    are pre-aggregated in one shuffle, so the window that picks the best source
    sees at most one row per person, source and date.
    """
    union = None
    for priority, source in enumerate(sources):
        rows = source.rows.where(F.col("person_id").isNotNull()).select(
            "person_id", "death_date", F.lit(priority).alias("priority"),
            F.lit(source.name).alias("death_source"), F.lit(source.first_only).alias("first"))
        union = rows if union is None else union.unionByName(rows)
    dates = union.groupBy(
        "person_id", "priority", "death_source", "first",
        F.when(~F.col("first"), F.col("death_date")).alias("_date"),
    ).agg(F.min("death_date").alias("death_date"), F.count(F.lit(1)).alias("copies"))
    best = F.min("priority").over(Window.partitionBy("person_id"))
    kept = dates.withColumn("_best", best).where("priority = _best").select(
        "person_id", "death_date", "death_source",
        F.when(F.col("first"), 1).otherwise(F.col("copies")).alias("copies"))
    if dedupe:
        kept = kept.groupBy("person_id", "death_source").agg(
            F.min("death_date").alias("death_date"), F.lit(1).cast("long").alias("copies"))
    return kept


def death_records(deaths: DataFrame) -> DataFrame:
    """One row per death record, as the sources list them."""
    return repeat_rows(deaths, "copies")


def all_deaths(tables: Mapping[str, DataFrame], cfg: StudyConfig,
               patterns: Sequence[str] = DEATH_CODE_PATTERNS) -> DataFrame:
    """The cascade over register, demographics, GP records and hospital stays."""
    codes = death_codes(tables["dictionary_a"], tables["dictionary_b"], patterns)
    return death_cascade([
        DeathSource(REGISTER, tables["death_register"]),
        DeathSource(DEMOGRAPHICS, tables["demographics"].where("death_date IS NOT NULL")),
        DeathSource(GP_RECORD, gp_deaths(
            tables["gp_event"], codes, cfg, literal_prefixes(patterns)), first_only=True),
        DeathSource(HOSPITAL, hospital_deaths(tables["inpatient_spell"], cfg), first_only=True),
    ], cfg.dedupe_deaths)
