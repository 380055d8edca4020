"""Comparison of a cohort with a clinic's patient list inside one area.

Membership in the various sets is computed once, as 0/1 flags on one row per
person of the alive, resident population.  Waterfall, confusion matrix and
disagreement groups are then filters and counts on those flags instead of
chains of anti-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.codes import CORE, INPATIENT, CodeSet
from cohortspark.config import StudyConfig
from cohortspark.functions.dates import years_between
from cohortspark.functions.rows import (
    compare_subsets,
    count_records,
    flag,
    records,
    top_row,
    weight,
)
from cohortspark.operators.describe import merged, moment_cells
from cohortspark.operators.events import EPISODE_KEYS, inpatient_diagnoses, tag
from cohortspark.operators.residence import region_areas

# Labels of results.
DISEASE = "MS"
NOT_ON_LIST = "Algorithm Only"
NO_HOSPITAL_RECORD = "Clinic List No Hospital Record"


def first_diagnosis(links: DataFrame, details: DataFrame, area_lookup: DataFrame,
                    cfg: StudyConfig) -> DataFrame:
    """Earliest diagnosis per person on the clinic list; people without an id count as one."""
    listed = links.join(details, "system_id").join(
        region_areas(area_lookup, cfg), "area_code", "left"
    ).select("person_id", "birth_date", "area_code", "district_code", "gender_cd",
             "diagnosis", "diagnosis_date", "onset_date")
    return top_row(listed, ["person_id"], [F.col("diagnosis_date").asc_nulls_last()])


def area_flags(population: DataFrame, first: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The alive, resident, classified population with set-membership flags.

    ``algorithm``: a case of the area with onset by the diagnosis limit.
    ``listed``: anywhere on the clinic list.  ``clinic``: listed with the disease,
    diagnosed in the study.  ``clinic_area``: that, and living in the area.
    """
    listed = first.where("person_id IS NOT NULL").select(
        "person_id", F.lit(1).alias("listed"),
        F.col("diagnosis").alias("list_diagnosis"),
        F.col("diagnosis_date").alias("list_diagnosis_date"),
        F.when(F.col("diagnosis") == DISEASE,
               years_between(F.col("diagnosis_date"), F.col("birth_date")))
        .alias("list_age_diagnosis"),
        F.when(F.col("diagnosis") == DISEASE,
               years_between(F.col("onset_date"), F.col("birth_date"))).alias("list_age_onset"),
    )
    in_time = F.col("list_diagnosis_date").between(F.lit(cfg.diagnosis_min),
                                                   F.lit(cfg.diagnosis_max))
    limit = F.lit(cfg.diagnosis_max)
    return (
        population.join(listed, "person_id", "left")
        .withColumn("listed", F.coalesce("listed", F.lit(0)))
        .withColumn("in_area", flag(F.col("board") == cfg.area_name))
        .withColumn("clinic", flag((F.col("list_diagnosis") == DISEASE) & in_time))
        .withColumn("clinic_area", F.col("clinic") * F.col("in_area"))
        .withColumn("algorithm", flag((F.col("is_case") == 1) & (F.col("potential_date") <= limit))
                    * F.col("in_area"))
        .withColumn("gp_only", flag(F.col("core_hospital_count") == 0))
    )


# Disagreement sets, as conditions on the flags.
MATCHED = "algorithm = 1 AND clinic_area = 1"
ALGORITHM_ONLY = "algorithm = 1 AND clinic_area = 0"
OTHERWISE_LISTED = "algorithm = 1 AND clinic_area = 0 AND listed = 1"
NOT_LISTED = "algorithm = 1 AND listed = 0"
NOT_LISTED_GP_ONLY = "algorithm = 1 AND listed = 0 AND gp_only = 1"
CLINIC_NO_HOSPITAL = "clinic_area = 1 AND gp_only = 1"
CLINIC_MISSED = "clinic_area = 1 AND algorithm = 0"


def area_compare(flags: DataFrame) -> DataFrame:
    """Size of each agreement and disagreement set: ``comparison, people``."""
    sets = {
        "algorithm in area": "algorithm = 1",
        "clinic list in population": "clinic = 1",
        "clinic list in area": "clinic_area = 1",
        "matched": MATCHED,
        "algorithm only": ALGORITHM_ONLY,
        "clinic list without hospital record": CLINIC_NO_HOSPITAL,
        "clinic list missed by algorithm": CLINIC_MISSED,
        "otherwise listed": OTHERWISE_LISTED,
        "not listed": NOT_LISTED,
        "not listed, primary care only": NOT_LISTED_GP_ONLY,
    }
    totals = flags.agg(*(count_records(flags, F.expr(c)).alias(n) for n, c in sets.items()))
    return totals.unpivot([], totals.columns, "comparison", "people")


def site_check_ids(flags: DataFrame) -> DataFrame:
    """People whose disagreement may be explained by where they were admitted.

    A person can be in only one of the two groups.
    """
    return flags.select(
        "person_id",
        F.when(F.expr(ALGORITHM_ONLY), NOT_ON_LIST)
        .when(F.expr(CLINIC_NO_HOSPITAL), NO_HOSPITAL_RECORD).alias("group"),
    ).where(F.col("group").isNotNull())


def in_site(cfg: StudyConfig) -> Column:
    return flag(F.col("unit").isin(list(cfg.site_units)))


def site_admissions(ids: DataFrame, spells: DataFrame, units: DataFrame,
                    cfg: StudyConfig) -> DataFrame:
    """Units that admitted each checked person, with unit name and a site flag."""
    seen = spells.select("person_id", "unit").join(ids, "person_id").distinct()
    return seen.join(units, "unit", "left").withColumn("in_site", in_site(cfg))


def admitted_at_site(spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Everyone with any admission, and whether one of them was at the sites."""
    return spells.where(F.col("person_id").isNotNull()) \
        .groupBy("person_id").agg(F.max(in_site(cfg)).alias("in_site"))


def site_check(ids: DataFrame, spells: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per checked person with any admission: was one of them at the sites?

    The flag is a maximum per person, so admissions combine before the shuffle;
    the first group by name stands for a person found in two.
    """
    return ids.join(admitted_at_site(spells, cfg), "person_id").groupBy("person_id").agg(
        F.min("group").alias("group"), F.max("in_site").alias("in_site"))


def site_tally(checked: DataFrame) -> DataFrame:
    return checked.groupBy("group", "in_site").agg(F.count(F.lit(1)).alias("people"))


def core_admissions(spells: DataFrame, episodes: DataFrame, diagnoses: DataFrame,
                    units: DataFrame, codeset: CodeSet, cfg: StudyConfig) -> DataFrame:
    """Distinct core-disease admissions with unit and unit name."""
    tagged = tag(diagnoses, codeset.only(CORE), INPATIENT, EPISODE_KEYS)
    return inpatient_diagnoses(spells, episodes, tagged, cfg) \
        .select("person_id", "unit", "event_date").distinct() \
        .join(units, "unit", "left")


def last_site_dates(admissions: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Last core admission at the sites, and elsewhere for people never seen there."""
    at_site, when = in_site(cfg) == 1, F.col("event_date")
    dates = admissions.groupBy("person_id").agg(
        F.max(F.when(at_site, when)).alias("site_date"),
        F.max(F.when(~at_site, when)).alias("elsewhere_date"))
    return dates.withColumn(
        "elsewhere_date", F.when(F.col("site_date").isNull(), F.col("elsewhere_date")))


def with_site_dates(flags: DataFrame, dates: DataFrame) -> DataFrame:
    """Flags plus last admission dates of the people the clinic list does not know."""
    unlisted = F.expr(NOT_LISTED)
    return flags.join(dates, "person_id", "left") \
        .withColumn("site_date", F.when(unlisted, F.col("site_date"))) \
        .withColumn("elsewhere_date", F.when(unlisted, F.col("elsewhere_date")))


def disagreement_breakdown(flags: DataFrame, dates: DataFrame, spells: DataFrame,
                           cfg: StudyConfig) -> DataFrame:
    """Algorithm-only people with their last core admission at the sites or elsewhere.

    Site flags and dates are one row per person and are joined to the flags as
    columns, so that the flags are read once.
    """
    located = with_site_dates(flags.where(ALGORITHM_ONLY), dates).where(
        F.col("site_date").isNotNull() | F.col("elsewhere_date").isNotNull())
    return located.withColumn("group", F.lit(NOT_ON_LIST)) \
        .join(admitted_at_site(spells, cfg), "person_id")


def summarise(people: DataFrame, gender: str, numeric: Sequence[str], digits: int = 1) -> DataFrame:
    """Women, and mean and standard deviation of the numeric columns, as one row.

    As in a plain mean, one missing value makes the result missing.
    """
    cells = moment_cells(people, {"_gender": F.col(gender)}, {c: F.col(c) for c in numeric})
    out = [F.coalesce(F.sum(F.when(F.col("_gender") == "Female", F.col("_records"))),
                      F.lit(0).cast("long")).alias("female")]
    for c in numeric:
        n, mean, sd = merged(c)
        whole = n == F.sum("_records")
        out.append(F.when(whole, F.round(mean, digits)).alias(f"mean_{c}"))
        out.append(F.when(whole, F.round(sd, digits)).alias(f"sd_{c}"))
    return cells.agg(*out)


def attrition_steps(flags: DataFrame, dates: DataFrame) -> DataFrame:
    """Each algorithm case of the area with the first exclusion that removes it."""
    cases = with_site_dates(flags, dates).where("algorithm = 1")
    excluded = (
        F.when(F.expr(OTHERWISE_LISTED), 1)
        .when(F.expr(NOT_LISTED_GP_ONLY), 2)
        .when(F.col("elsewhere_date").isNotNull(), 3)
    )
    return cases.withColumn("excluded_at", excluded)


def attrition(flags: DataFrame, dates: DataFrame) -> DataFrame:
    """People left after each exclusion step: ``step, label, people``."""
    left = F.coalesce(F.col("excluded_at"), F.lit(99))
    steps = [
        ("algorithm cases in area", left > 0),
        ("not otherwise listed by the clinic", left > 1),
        ("not primary care only", left > 2),
        ("not last admitted elsewhere", left > 3),
        ("and not on the clinic list", (left > 3) & (F.col("clinic") == 0)),
    ]
    cases = attrition_steps(flags, dates)
    totals = cases.agg(*(count_records(cases, c).alias(n) for n, c in steps))
    number = F.array_position(F.array(*(F.lit(n) for n, _ in steps)), F.col("label"))
    return totals.unpivot([], totals.columns, "label", "people") \
        .select(number.cast("int").alias("step"), "label", "people")


def confusion(flags: DataFrame, predicted: str, gold: str) -> DataFrame:
    """People per predicted and gold flag."""
    return flags.groupBy(predicted, gold).agg(count_records(flags).alias("people")) \
        .withColumn("cell", F.concat(
            F.when(F.col(predicted) == F.col(gold), "true ").otherwise("false "),
            F.when(F.col(predicted) == 1, "positive").otherwise("negative")))


# The people of the area in neither set, derived from either side.
NEGATIVE_BY_ALGORITHM = (f"in_area = 1 AND NOT (algorithm = 1 AND NOT ({OTHERWISE_LISTED})) "
                         f"AND NOT ({CLINIC_MISSED})")
NEGATIVE_BY_CLINIC = f"in_area = 1 AND clinic_area = 0 AND NOT ({NOT_LISTED})"


def true_negatives_two_ways(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_algorithm, by_clinic = (records(flags.where(c)).select("person_id") for c in (
        NEGATIVE_BY_ALGORITHM, NEGATIVE_BY_CLINIC))
    return by_algorithm, by_clinic


def compare_true_negatives(flags: DataFrame) -> DataFrame:
    """Size of both derivations and people that differ, in one pass over the flags."""
    area = flags.where("in_area = 1")
    left, right = (F.when(F.expr(c), weight(flags)).otherwise(F.lit(0).cast("long"))
                   for c in (NEGATIVE_BY_ALGORITHM, NEGATIVE_BY_CLINIC))
    return compare_subsets(area, ["person_id"], left, right)
