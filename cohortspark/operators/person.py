"""One row per person: master frame, event counts, cleaned population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.codes import CORE, COUNTED_CONCEPTS
from cohortspark.config import StudyConfig
from cohortspark.functions.dates import years_between
from cohortspark.functions.labels import GENDERS, decode
from cohortspark.functions.rows import truthy
from cohortspark.operators.events import SOURCES

HOUSEHOLD_COLUMNS = {
    "household_id": "long", "household_area_code": "string", "household_district_code": "string",
    "household_start": "date", "household_end": "date", "household_board": "string",
}
FEATURE_COLUMNS = (
    "core_date", "core_age", "potential_date", "potential_age", "nmo_date", "nmo_age",
    "nmo_last_date", "core_event_3_date", "core_event_7_date", "family_history_date",
    "family_history_age",
)
COUNT_COLUMNS = tuple(f"{c}_{s.lower()}_count" for c in COUNTED_CONCEPTS for s in SOURCES)


def known_persons(persons: DataFrame, contact: DataFrame) -> DataFrame:
    """Resolved persons with a first contact, and their gender label."""
    return persons.join(contact, "person_id") \
        .withColumn("gender", decode(F.col("gender_cd"), GENDERS))


def person_base(persons: DataFrame, contact: DataFrame, deaths: DataFrame,
                cfg: StudyConfig) -> DataFrame:
    """Known persons with death, exit date and current age.

    A person with several death dates keeps a row per date, and ``copies`` says
    for how many death records it stands.  People who would leave before birth,
    or born after the ceiling year, are dropped.
    """
    death, last_day = F.col("death_date"), F.lit(cfg.date_max)
    dead = truthy(death <= last_day)
    exit_date = F.when(dead, death).otherwise(last_day)
    return (
        known_persons(persons, contact)
        .join(deaths, "person_id", "left")
        .withColumns({
            "copies": F.coalesce("copies", F.lit(1).cast("long")),
            "birth_year": F.year("birth_date"), "death_year": F.year("death_date"),
            "dead": dead.cast("int"), "exit_date": exit_date,
            "age_current": years_between(exit_date, F.col("birth_date")),
        })
        .where((F.col("age_current") >= 0) & (F.col("birth_year") < cfg.birth_year_ceiling))
    )


def person_frame(base: DataFrame, features: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """Known persons with onsets, nth events, core event counts and any further ``counts``.

    Both inputs are keyed by the person, so the join needs no shuffle of its own.
    """
    core_counts = [f"{CORE}_{s.lower()}_count" for s in SOURCES]
    # counts only describe people who have a core event
    wanted = features.select("person_id", *FEATURE_COLUMNS, *(
        F.when(F.col("core_date").isNotNull(), F.col(c)).alias(c) for c in core_counts),
        *(c for c in counts if c not in core_counts))
    return base.join(wanted, "person_id", "left")


def with_places(people: DataFrame, location: DataFrame,
                household: DataFrame | None = None) -> DataFrame:
    """Add area, district, board and household; typed nulls where households are not held.

    Kept apart from the event frame, so that results which do not ask where
    people live never read the address tables.
    """
    placed = people.join(location, "person_id", "left")
    if household is not None:
        return placed.join(household.select("person_id", *HOUSEHOLD_COLUMNS), "person_id", "left")
    return placed.withColumns({c: F.lit(None).cast(t) for c, t in HOUSEHOLD_COLUMNS.items()})


def person_counts(persons: DataFrame, contact: DataFrame, features: DataFrame,
                  faithful: bool = True) -> DataFrame:
    """Event counts per person, concept and source, 0 where there are none.

    ``faithful`` also writes a missing gender as ``"0"``, as a blanket
    null-to-zero fill does.
    """
    out = known_persons(persons, contact).join(
        features.select("person_id", *COUNT_COLUMNS), "person_id", "left") \
        .fillna(0, ["gender_cd", *COUNT_COLUMNS])
    return out.fillna("0", ["gender"]) if faithful else out


def plausible(people: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Deaths after the study count as alive; implausible and undetermined people go.

    People born before the floor year without a death are taken to be lost records.
    """
    died = F.col("death_date") <= F.lit(cfg.date_max)
    return (
        people.withColumns({"death_date": F.when(died, F.col("death_date")),
                            "death_year": F.when(died, F.col("death_year"))})
        .where(~truthy((F.col("birth_year") < cfg.birth_year_floor)
                       & F.col("death_date").isNull()))
        .where(F.col("gender") != "Undetermined")
    )


def clean_population(frame: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The plausible people of the person frame with ages at death or at study end."""
    birth, death = F.col("birth_date"), F.col("death_date")
    return plausible(frame, cfg).withColumns({
        "core_year": F.year("core_date"),
        "potential_year": F.year("potential_date"),
        "core_count": F.col("core_gp_count") + F.col("core_hospital_count"),
        "age_death": years_between(death, birth),
        "age_end": F.when(death.isNull(), years_between(F.lit(cfg.date_max), birth)),
    })


def alive_resident(population: DataFrame, residents: DataFrame) -> DataFrame:
    """People of a population who are alive and resident at the end of the study."""
    return population.where("dead = 0").join(residents, "person_id", "left_semi")
