"""Questionnaire answers: typed, latest per person, and joined to a population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.dates import partial_date, whole_number, years_between
from cohortspark.functions.labels import (
    TYPE_AT_DIAGNOSIS_ANSWERS,
    TYPE_NOW_ANSWERS,
    decode,
    first_answer,
    known_or_unknown,
    merge_labels,
    presence,
)
from cohortspark.functions.rows import top_row
from cohortspark.operators.identity import with_surrogate_ids

ANSWER_KEYS = ("user_id", "completed", "group_id")
BENIGN_GROUP = "Benign/RRMS"


def onset_columns(cfg: StudyConfig) -> dict[str, Column]:
    """Year and month of first symptoms as numbers and as a date."""
    year, month = whole_number(F.col("onset_year")), whole_number(F.col("onset_month"))
    return {"onset_year": year, "onset_month": month,
            "onset_date": partial_date(year, month, cfg.year_max)}


def type_now_columns(cfg: StudyConfig) -> dict[str, Column]:
    """Current type from the first answered of four questions, and since when."""
    year, month = whole_number(F.col("now_year")), whole_number(F.col("now_month"))
    answer = first_answer(F.col(c) for c in
                          ("now_unsure", "now_primary", "now_relapsing", "now_secondary"))
    return {"type_now": decode(answer, TYPE_NOW_ANSWERS), "now_year": year, "now_month": month,
            "now_date": partial_date(year, month, cfg.year_max)}


def diagnosis_columns(cfg: StudyConfig) -> dict[str, Column]:
    """Type and date at diagnosis; a missing month counts as January."""
    year, month = whole_number(F.col("diagnosis_year")), whole_number(F.col("diagnosis_month"))
    answer = first_answer([F.col("type_at_diagnosis")])
    return {"type_at_diagnosis": decode(answer, TYPE_AT_DIAGNOSIS_ANSWERS),
            "diagnosis_year": year, "diagnosis_month": month,
            "diagnosis_date": partial_date(year, month, cfg.year_max,
                                           missing_month_is_january=True)}


def typed_answers(raw: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every questionnaire with its answers as numbers, dates and labels."""
    columns = onset_columns(cfg) | type_now_columns(cfg) | diagnosis_columns(cfg)
    return raw.select(*ANSWER_KEYS, *(c.alias(n) for n, c in columns.items()))


def latest_questionnaire(raw: DataFrame, demographics: DataFrame) -> DataFrame:
    """Latest questionnaire per person: by completion, then by group.

    Unlinked users stand for themselves.  Questionnaires are cut to one per
    user before they meet the register, so a busy user costs one row.
    """
    order = [F.col("completed").desc_nulls_last(), F.col("group_id").desc_nulls_last()]
    per_user = top_row(raw, ["user_id"], order)
    people = demographics.select("user_id", "person_id", "birth_date", "gender_cd")
    linked = with_surrogate_ids(per_user.join(people, "user_id", "left"))
    return top_row(linked, ["person_id"], [*order, F.col("user_id").asc()])


def latest_answers(raw: DataFrame, demographics: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Answers and ages of each person's latest questionnaire.

    The three parts (type now, onset, diagnosis) come from the same
    questionnaire, so it is found once.  ``now_valid``, ``onset_valid`` and
    ``diagnosis_valid`` tell which parts lie within the study.
    """
    latest = latest_questionnaire(raw, demographics)
    person = ["person_id", "birth_date", "gender_cd"]
    typed = latest.select(*ANSWER_KEYS, *person, *(c.alias(n) for n, c in (
        onset_columns(cfg) | type_now_columns(cfg) | diagnosis_columns(cfg)).items()))

    def by_study_end(column: str) -> Column:
        return F.col(column).isNull() | (F.col(column) <= F.lit(cfg.date_max))

    def age_at(column: str) -> Column:
        return F.when(F.col(column) >= F.col("birth_date"),
                      years_between(F.col(column), F.col("birth_date")))

    return typed.withColumns({
        "type_now": merge_labels(known_or_unknown(F.col("type_now")), ["Benign", "RRMS"],
                                 BENIGN_GROUP),
        "type_at_diagnosis": known_or_unknown(F.col("type_at_diagnosis")),
        "age_onset": age_at("onset_date"), "age_onset_known": presence(age_at("onset_date")),
        "age_diagnosis": age_at("diagnosis_date"),
        "age_diagnosis_known": presence(age_at("diagnosis_date")),
        "now_valid": by_study_end("now_date"), "onset_valid": by_study_end("onset_date"),
        "diagnosis_valid": by_study_end("diagnosis_date"),
    })


PARTS = {
    "now": ("type_now", "now_date"),
    "onset": ("onset_date", "age_onset", "age_onset_known"),
    "diagnosis": ("type_at_diagnosis", "diagnosis_date", "age_diagnosis", "age_diagnosis_known"),
}


def latest_part(answers: DataFrame, part: str) -> DataFrame:
    """People whose latest answer of one part lies within the study."""
    return answers.where(f"{part}_valid").select(
        *ANSWER_KEYS, "person_id", "birth_date", "gender_cd", *PARTS[part])


def join_answers(people: DataFrame, answers: DataFrame) -> DataFrame:
    """Latest answers beside each person; null where a part is missing or not valid."""
    shown = [F.when(F.col(f"{part}_valid"), F.col(c)).alias(c)
             for part, columns in PARTS.items() for c in columns]
    submitted = F.when(F.col("diagnosis_valid"), F.col("completed")).alias("submitted")
    return people.join(answers.select("person_id", *shown, submitted), "person_id", "left")


def with_answers(people: DataFrame, answers: DataFrame) -> DataFrame:
    """``join_answers``, with people who gave none counted as of unknown type."""
    return join_answers(people, answers).withColumns(
        {c: known_or_unknown(F.col(c)) for c in ("type_now", "type_at_diagnosis")})


def diagnosed_in_study(df: DataFrame, cfg: StudyConfig, column: str = "diagnosis_date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(cfg.diagnosis_min), F.lit(cfg.diagnosis_max)))
