"""Comparison of a cohort with a self-reported register."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.labels import (
    GENDERS,
    PRESENT,
    UNKNOWN,
    decode,
    merge_labels,
    presence,
)
from cohortspark.functions.rows import single_row_ids, weight
from cohortspark.operators.identity import with_surrogate_ids
from cohortspark.operators.responses import diagnosed_in_study, join_answers, with_answers

# Labels of results and the placeholder birth date of unusable records.
FOUND = "Disease Present and Tested Positive"
MISSED = "Disease Present and Tested Negative"
PLACEHOLDER_BIRTH = date(1900, 1, 1)


def register_profile(population: DataFrame, members: DataFrame, answers: DataFrame,
                     cfg: StudyConfig, diagnosed_only: bool = True) -> DataFrame:
    """Register members found in the population, with their latest answers."""
    found = population.join(members.select("person_id"), "person_id", "left_semi")
    profile = with_answers(found, answers)
    return diagnosed_in_study(profile, cfg) if diagnosed_only else profile


def match_miss(profile: DataFrame, cohort: DataFrame, group: str,
               known_type_only: bool = False) -> DataFrame:
    """Every profiled row once, labelled found or missed by the cohort, in one join.

    A cohort person with several rows counts as one, so records are never paired.

    Both sides are long chains of sorts and aggregates by person, which hold memory until a task
    ends.  Dealt by the person alone, they would run in the tasks of the join; so both are dealt
    again by the person and its hash, and each chain has tasks of its own.
    """
    dealt = ["_person", "person_id"]
    person = F.xxhash64("person_id")
    diagnosed = cohort.select("person_id", "diagnosis_year", "diagnosis_age").distinct() \
        .withColumns({"_person": person, "_found": F.lit(True)}).repartition(*dealt)
    label = F.when(F.col("_found"), FOUND).otherwise(MISSED)
    out = (
        profile.withColumn("_person", person).repartition(*dealt).join(diagnosed, dealt, "left")
        .withColumn("sub_group", label).drop("_person", "_found")
        .withColumns({
            "diagnosis_age_known": presence(F.col("diagnosis_age")),
            "group": F.lit(group),
            "all_group": F.concat_ws(" - ", F.lit(group), F.col("sub_group")),
        })
    )
    return out.where(F.col("type_at_diagnosis") != UNKNOWN) if known_type_only else out


def match_own_cases(profile: DataFrame, group: str, whole: str | None = None) -> DataFrame:
    """``match_miss`` against the cases of the profile's own population.

    The profile already carries the verdict and the onset of each person, so no
    second frame is needed.  ``whole`` adds every profiled row once more as one
    undivided group of that name, in the same pass.
    """
    found = F.col("is_case") == 1
    label = F.when(found, FOUND).otherwise(MISSED)

    def cell(year: Column, age: Column, sub_group: Column, name: str,
             all_group: Column) -> Column:
        return F.struct(
            year.cast("int").alias("diagnosis_year"), age.cast("double").alias("diagnosis_age"),
            presence(age).alias("diagnosis_age_known"), sub_group.alias("sub_group"),
            F.lit(name).alias("group"), all_group.alias("all_group"))

    none = F.lit(None)
    cells = [cell(F.when(found, F.col("potential_year")), F.when(found, F.col("potential_age")),
                  label, group, F.concat_ws(" - ", F.lit(group), label))]
    if whole is not None:
        cells.append(cell(none, none, F.lit(""), whole, F.lit(whole)))
    return profile.withColumn("_cell", F.explode(F.array(*cells))) \
        .select(*profile.columns, "_cell.*")


def type_tallies(profile: DataFrame) -> DataFrame:
    """People per current type and per type at diagnosis, in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("question"), F.col(c).alias("type"))
                      for c in ("type_now", "type_at_diagnosis")))
    told = profile.select(F.explode(cells).alias("cell"), weight(profile).alias("copies"))
    return told.groupBy("cell.question", "cell.type").agg(F.sum("copies").alias("people"))


def usable_users(users: DataFrame) -> DataFrame:
    """The users of ``valid_users`` with a usable record."""
    return users.where("invalid_user = 0")


def with_progressive_groups(df: DataFrame) -> DataFrame:
    """Add type columns with the two progressive types counted together."""
    return df.withColumns({
        f"{c}_group": merge_labels(F.col(c), ["PPMS", "SPMS"], "Progressive")
        for c in ("type_now", "type_at_diagnosis")
    })


def valid_users(demographics: DataFrame, answers: DataFrame) -> DataFrame:
    """Register users with exactly one distinct record, and whether it is usable."""
    usable = (F.col("diagnosis_date").isNotNull() & F.col("birth_date").isNotNull()
              & (F.col("birth_date") != F.lit(PLACEHOLDER_BIRTH)) & F.col("gender_cd").isin(1, 2))
    # the usability flag sees the gender code, the single-record check only its label
    gender = decode(F.col("gender_cd"), {k: GENDERS[k] for k in (1, 2)}, UNKNOWN)
    shown = with_surrogate_ids(demographics).select(
        "person_id", "birth_date", "gender_cd", gender.alias("gender"))
    joined = join_answers(shown, answers).select(
        "person_id", "birth_date", "gender", "onset_date", "age_onset", "age_onset_known",
        "type_now", "type_at_diagnosis", "diagnosis_date", "age_diagnosis",
        F.when(usable, 0).otherwise(1).alias("invalid_user"))
    return single_row_ids(joined, "person_id") \
        .withColumn("age_diagnosis_known", F.lit(PRESENT))
