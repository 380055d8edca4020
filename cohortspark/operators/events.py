"""Coded events from several kinds of record, tagged with concepts and cleaned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.codes import GP, INPATIENT, OUTPATIENT, CodeSet
from cohortspark.config import StudyConfig
from cohortspark.functions.dates import years_between
from cohortspark.functions.rows import truthy
from cohortspark.sources.tables import in_study

GP_SOURCE, HOSPITAL_SOURCE = "GP", "HOSPITAL"
SOURCES = (GP_SOURCE, HOSPITAL_SOURCE)
EVENT_COLUMNS = ("person_id", "event_date", "source", "concept", "code")
SPELL_KEYS = ("unit", "spell_no")
EPISODE_KEYS = (*SPELL_KEYS, "episode_no")
OUTPATIENT_KEYS = ("unit", "available_date", "attendance_id", "case_no", "attended_date")


def tag(records: DataFrame, codeset: CodeSet, system: str,
        keep: Sequence[str | Column]) -> DataFrame:
    """``keep`` columns plus ``concept`` and ``code`` of records in the code set.

    The code condition is a plain predicate, so it reaches the scan.  The code
    is kept only for concepts whose events are told apart by code.
    """
    names = codeset.concepts(system)
    hits = F.array(*(F.when(codeset.condition(system, n), F.lit(n)) for n in names))
    concept = F.col("concept")
    return (
        records.where(codeset.condition(system))
        .select(*keep, "code", F.explode(hits).alias("concept"))
        .where(concept.isNotNull())
        .withColumn("code", F.when(concept.isin(list(codeset.by_code)), F.col("code")))
    )


def gp_events(events: DataFrame, codeset: CodeSet, cfg: StudyConfig) -> DataFrame:
    """Tagged primary-care events of the study period, repeats included."""
    linked = events.where(F.col("person_id").isNotNull() & in_study("event_date", cfg))
    return tag(linked, codeset, GP, ["person_id", "event_date"]) \
        .withColumn("source", F.lit(GP_SOURCE)).select(*EVENT_COLUMNS)


def inpatient_diagnoses(spells: DataFrame, episodes: DataFrame, tagged: DataFrame,
                        cfg: StudyConfig) -> DataFrame:
    """Tagged diagnoses with the person and admission of their spell.

    Diagnoses are cut to the wanted codes first, and episodes to the keys of
    those, a small side that Spark can broadcast; only then are episodes made
    distinct and joined, so that none of the others is shuffled.  What is left
    is distinct per spell before it meets the spells.
    """
    stays = spells.where(F.col("person_id").isNotNull() & in_study("admission_date", cfg)) \
        .select(*SPELL_KEYS, "person_id", F.col("admission_date").alias("event_date"))
    wanted = tagged.select(*EPISODE_KEYS).distinct()
    known = episodes.select(*EPISODE_KEYS).join(wanted, list(EPISODE_KEYS), "left_semi").distinct()
    found = tagged.join(known, list(EPISODE_KEYS)).drop("episode_no").distinct()
    return stays.join(found, list(SPELL_KEYS), "inner")


def inpatient_events(spells: DataFrame, episodes: DataFrame, diagnoses: DataFrame,
                     codeset: CodeSet, cfg: StudyConfig) -> DataFrame:
    """Tagged inpatient events, dated by admission; a person may repeat an event."""
    tagged = tag(diagnoses, codeset, INPATIENT, EPISODE_KEYS)
    return inpatient_diagnoses(spells, episodes, tagged, cfg) \
        .withColumn("source", F.lit(HOSPITAL_SOURCE)).select(*EVENT_COLUMNS)


def outpatient_events(visits: DataFrame, diagnoses: DataFrame, codeset: CodeSet,
                      cfg: StudyConfig) -> DataFrame:
    """Tagged outpatient events, dated by attendance; a person may repeat an event.

    Visits and wanted diagnoses meet on the hash of their five keys first, and
    the wanted diagnoses are no more than a filter over their scan.  So, where
    they are too many to broadcast, Spark builds a Bloom filter of whole visits
    from them and applies it at the scan of the visits, and only visits that
    have a wanted diagnosis are shuffled.
    """
    visit = F.xxhash64(*OUTPATIENT_KEYS).alias("_visit")
    coded = diagnoses.where(in_study("attended_date", cfg)).withColumn(
        "code", F.concat("stem", F.coalesce("fourth", F.lit(""))))
    wanted = coded.where(codeset.condition(OUTPATIENT)) \
        .select(visit, *OUTPATIENT_KEYS, "stem", "code")
    people = visits.where(F.col("person_id").isNotNull()) \
        .select(visit, *OUTPATIENT_KEYS, "person_id")
    met = people.join(wanted, ["_visit", *OUTPATIENT_KEYS], "inner")
    return tag(met, codeset, OUTPATIENT, ["person_id", F.col("attended_date").alias("event_date")]) \
        .withColumn("source", F.lit(HOSPITAL_SOURCE)).select(*EVENT_COLUMNS)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Events of all sources, each distinct event once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def tag_all_sources(tables: Mapping[str, DataFrame], codeset: CodeSet,
                    cfg: StudyConfig) -> DataFrame:
    """Every concept of the code set from all three sources, one pass per source."""
    return union_sources(
        gp_events(tables["gp_event"], codeset, cfg),
        inpatient_events(tables["inpatient_spell"], tables["inpatient_episode"],
                         tables["inpatient_diagnosis"], codeset, cfg),
        outpatient_events(tables["outpatient"], tables["outpatient_diagnosis"], codeset, cfg),
    )


def attach_demographics(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Events of resolved persons, with birth date and gender."""
    return events.join(persons.select("person_id", "birth_date", "gender_cd"), "person_id")


def with_event_age(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Events of resolved persons with the age at the event."""
    return attach_demographics(events, persons).withColumn(
        "event_age", years_between(F.col("event_date"), F.col("birth_date")))


def weighted_events(events: DataFrame, persons: DataFrame, deaths: DataFrame) -> DataFrame:
    """Events of resolved persons that are neither before birth nor after death, once each.

    ``deaths`` has one row per person and death date, with the ``copies`` of
    that date.  A person with several recorded deaths has an event once per
    death that is not before it.  Instead of repeating the row, ``dates``
    counts these distinct death dates (1 without deaths) and ``copies`` the
    death records.  Events and deaths of a person are merged in the order of
    their dates, latest first, and an event's place in the running counts of
    deaths gives both numbers: a person's work is the sum of events and
    deaths, not their product, and no row carries more than a few numbers.
    """
    none = F.lit(0).cast("long")
    # a death on the day of an event comes before it; one without a date bars nothing, so it comes
    # first, as does a mark that deaths are recorded
    death = F.struct(F.lit(1).alias("_kind"), F.col("death_date").alias("event_date"),
                     F.lit(1).cast("long").alias("_dates"), F.col("copies").alias("_copies"))
    mark = F.struct(F.lit(2).alias("_kind"), F.lit(None).cast("date").alias("event_date"),
                    none.alias("_dates"), none.alias("_copies"))
    died = deaths.select("person_id", F.explode(F.array(death, mark)).alias("_row")) \
        .select("person_id", "_row.*")
    merged = events.withColumns({"_kind": F.lit(0), "_dates": none, "_copies": none}) \
        .unionByName(died, allowMissingColumns=True)
    later = Window.partitionBy("person_id").orderBy(
        F.col("event_date").desc_nulls_first(), F.col("_kind").desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.lit(1).cast("long")
    recorded = F.col("_marks") > 0
    return (
        with_event_age(merged, persons).where("_kind > 0 OR event_age >= 0")
        .withColumns({
            "_marks": F.sum((F.col("_kind") == 2).cast("long")).over(later),
            "_dates": F.sum("_dates").over(later), "_copies": F.sum("_copies").over(later)})
        .where("_kind = 0")
        .withColumns({"dates": F.when(recorded, F.col("_dates")).otherwise(one),
                      "copies": F.when(recorded, F.col("_copies")).otherwise(one)})
        .where("dates > 0").drop("_kind", "_marks", "_dates", "_copies")
    )


def valid_events(events: DataFrame, persons: DataFrame, deaths: DataFrame) -> DataFrame:
    """``weighted_events`` with a row per distinct death date, for results that show it.

    ``deaths`` has one row per person and death date; ``copies`` says how many
    death records share that date.
    """
    after_death = truthy(F.col("death_date") < F.col("event_date"))
    return (
        with_event_age(events, persons).where("event_age >= 0")
        .join(deaths.select("person_id", "death_date", "copies"), "person_id", "left")
        .where(~after_death)
        .withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    )


def count_by_source(events: DataFrame, keys: Sequence[str] = ("person_id",),
                    sources: Sequence[str] = SOURCES) -> DataFrame:
    """Events per person and source as columns, 0 where a source has none."""
    counts = events.groupBy(*keys).pivot("source", list(sources)).agg(F.sum("copies"))
    names = {s: f"{s.lower()}_count" for s in sources}
    return counts.withColumnsRenamed(names).fillna(0, list(names.values()))
