"""Registered queries: every operator of the library over the star-schema inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.codes import CORE, GP, CodeSet
from cohortspark.config import StudyConfig
from cohortspark.functions.labels import age_bracket
from cohortspark.functions.rows import count_records, in_set, not_in_set, records, union_ids
from cohortspark.operators import (
    clinic,
    deaths,
    describe,
    events,
    identity,
    person,
    register,
    residence,
    responses,
    timeline,
)
from cohortspark.plans.pipeline import ALIVE, ALL, STAGE_AGE_GROUPS, CohortStudy
from cohortspark.sources import analogs
from cohortspark.sources.sinks import ROW_BUDGET, within_budget, write_report
from cohortspark.sources.stages import StageStore, shared_folder
from cohortspark.sources.tables import conform, open_tables, scan_coded_events

CFG, CODES = analogs.STUDY, analogs.CODES
EVENT_COLUMNS = ("person_id", "event_date", "event_year", "code", "value", "sequence")
PREFIXES = ("1P", "2F")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def study(spark: SparkSession, folder: str) -> CohortStudy:
    return CohortStudy(analogs.study_tables(spark, folder), CFG, CODES, analogs.DEATH_PATTERNS)


def query(build: Callable[[CohortStudy], DataFrame]) -> Callable[[CohortStudy], DataFrame]:
    """Register a query under its function name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(study(spark, folder))
    QUERIES[build.__name__] = run
    return build


def gp_codes(codes: CodeSet = CODES) -> list[str]:
    return sorted({r.value for r in codes.rules if r.system == GP})


# scans

@query
def scan_coded_events_query(s: CohortStudy) -> DataFrame:
    return scan_coded_events(s.tables["gp_event"], CFG, gp_codes(), columns=EVENT_COLUMNS)


@query
def prefix_codes(s: CohortStudy) -> DataFrame:
    return scan_coded_events(s.tables["gp_event"], CFG, prefixes=PREFIXES, columns=EVENT_COLUMNS)


@query
def conform_events(s: CohortStudy) -> DataFrame:
    """A text extract with padded codes, blanks and bad numbers and dates, at its schema."""
    return conform(s.tables["raw_event"], "gp_event").select(*EVENT_COLUMNS)


@query
def event_count_guard(s: CohortStudy) -> DataFrame:
    return within_budget(scan_coded_events(s.tables["gp_event"], CFG, gp_codes()), ROW_BUDGET)


# snapshots of the events on these days; the study looks back from a day between two of them
SNAPSHOT_DAYS = ("19971231", "19981231", "20001231")
AS_OF = "19990615"


def opened(spark: SparkSession, snapshots: dict[str, DataFrame], cfg: StudyConfig,
           names: Sequence[str]) -> Mapping[str, DataFrame]:
    """The named tables as a study opens them, while ``snapshots`` are in the catalog."""
    for name, df in snapshots.items():
        df.createOrReplaceTempView(name)
    try:
        return open_tables(spark, names, cfg)
    finally:
        for name in snapshots:
            spark.catalog.dropTempView(name)


def snapshot_events(spark: SparkSession, folder: str) -> DataFrame:
    """Coded events from the snapshot that the study's date resolves to."""
    events_ = study(spark, folder).tables["gp_event"]
    stored = {f"gp_event_{day}": events_.where(F.col("event_date") <= F.to_date(F.lit(day), "yyyyMMdd"))
              for day in SNAPSHOT_DAYS}
    tables = opened(spark, stored, replace(CFG, as_of=AS_OF), ["gp_event"])
    return scan_coded_events(tables["gp_event"], CFG, gp_codes(), columns=EVENT_COLUMNS)


def csv_area_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Areas with the board from a lookup that was written as a report and read as a CSV file."""
    s = study(spark, folder)
    path = f"{stored_files(spark)}/board_lookup_{uuid.uuid4().hex}"
    write_report(s.tables["board_lookup"], path)
    cfg = replace(CFG, lookup_files={"board_lookup": path})
    boards = open_tables(spark, ["board_lookup"], cfg)["board_lookup"]
    located = s.tables["residence_area"].select("person_id", "area_code").distinct()
    return residence.with_board(located, s.tables["area_lookup"], boards, CFG)


def staged_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The case cohort from stages that are stored by person and read back from the catalog."""
    run = f"queries-{spark.sparkContext.applicationId}"
    s = CohortStudy(analogs.study_tables(spark, folder), CFG, CODES, analogs.DEATH_PATTERNS,
                    stages=StageStore(spark, run, folder=stored_files(spark)))
    return s.cases(ALL).select(*COHORT_COLUMNS, "reason", "time_to_trigger", "diagnosis_year",
                               "diagnosis_bracket")


def stored_files(spark: SparkSession) -> str:
    """A folder that all machines share: the cluster's for checkpoints, else its warehouse."""
    return shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")


QUERIES |= {f.__name__: f for f in (snapshot_events, csv_area_lookup, staged_cases)}


# identity

@query
def identity_resolve(s: CohortStudy) -> DataFrame:
    return s.persons()


@query
def register_cohort(s: CohortStudy) -> DataFrame:
    return identity.register_cohort(s.tables["register_link"], CFG)


@query
def surrogate_ids(s: CohortStudy) -> DataFrame:
    return identity.with_surrogate_ids(
        identity.register_demographics(s.tables["register_link"], CFG))


@query
def reconcile_demographics(s: CohortStudy) -> DataFrame:
    return records(s.register_demographics())


# events

@query
def concept_tagging(s: CohortStudy) -> DataFrame:
    return s.tagged()


@query
def regex_codes(s: CohortStudy) -> DataFrame:
    return deaths.discover_codes(
        deaths.code_dictionary(s.tables["dictionary_a"], s.tables["dictionary_b"]),
        s.death_patterns)


@query
def inpatient_events(s: CohortStudy) -> DataFrame:
    t = s.tables
    return events.union_sources(events.inpatient_events(
        t["inpatient_spell"], t["inpatient_episode"], t["inpatient_diagnosis"], CODES, CFG))


@query
def outpatient_events(s: CohortStudy) -> DataFrame:
    return events.union_sources(events.outpatient_events(
        s.tables["outpatient"], s.tables["outpatient_diagnosis"], CODES, CFG))


@query
def union_sources(s: CohortStudy) -> DataFrame:
    return events.tag_all_sources(s.tables, CODES.only(CORE), CFG) \
        .select("person_id", "event_date", "source")


@query
def semi_filter(s: CohortStudy) -> DataFrame:
    """Hospital stays of people with any death record."""
    ids = union_ids([s.tables["death_register"], s.tables["demographics"]], "person_id")
    return in_set(s.tables["inpatient_spell"], ids, "person_id") \
        .select("person_id", "unit", "spell_no", "admission_date")


@query
def anti_filter(s: CohortStudy) -> DataFrame:
    """Person records, unlinked ones too, without a core event."""
    core = events.gp_events(s.tables["gp_event"], CODES.only(CORE), CFG)
    return not_in_set(s.tables["person_source"], core, "person_id")


@query
def valid_events(s: CohortStudy) -> DataFrame:
    return s.valid_records()


@query
def source_event_counts(s: CohortStudy) -> DataFrame:
    return events.count_by_source(s.valid(), ("person_id", "concept"))


# timelines

@query
def first_contact(s: CohortStudy) -> DataFrame:
    return s.contact()


@query
def registration_span(s: CohortStudy) -> DataFrame:
    return timeline.span(s.tables["inpatient_spell"], "admission_date")


def _potential(s: CohortStudy) -> DataFrame:
    return s.valid().where(F.col("concept").isin(list(timeline.POTENTIAL_CONCEPTS)))


@query
def first_event(s: CohortStudy) -> DataFrame:
    return timeline.first_event(_potential(s))


@query
def nth_event(s: CohortStudy) -> DataFrame:
    return timeline.nth_event(_potential(s), 3)


@query
def last_event(s: CohortStudy) -> DataFrame:
    return timeline.last_event(_potential(s))


@query
def person_features(s: CohortStudy) -> DataFrame:
    return s.features()


# deaths, residence

@query
def death_cascade(s: CohortStudy) -> DataFrame:
    return deaths.death_records(s.deaths())


@query
def latest_location(s: CohortStudy) -> DataFrame:
    return residence.latest_location(s.tables["residence_area"], CFG)


@query
def area_lookup(s: CohortStudy) -> DataFrame:
    located = s.tables["residence_area"].select("person_id", "area_code").distinct()
    return residence.with_board(located, s.tables["area_lookup"], s.tables["board_lookup"], CFG)


# persons and cohorts

@query
def person_frame(s: CohortStudy) -> DataFrame:
    return s.frame()


@query
def person_counts(s: CohortStudy) -> DataFrame:
    return s.counts()


@query
def clean_population(s: CohortStudy) -> DataFrame:
    return person.clean_population(s.frame(), CFG)


@query
def classify_cases(s: CohortStudy) -> DataFrame:
    people = s.people()
    return people.groupBy("gender", "dead", "is_case").agg(
        count_records(people).alias("people"), F.min("potential_date").alias("first_onset"),
        F.max("core_count").alias("most_events"))


@query
def alive_resident(s: CohortStudy) -> DataFrame:
    return records(s.located_alive()).select("person_id", "gender", "birth_date", "age_current", "board",
                                    "is_case")


COHORT_COLUMNS = ("person_id", "gender", "birth_date", "first_contact", "core_date",
                  "potential_date", "core_count", "diagnosis_age", "age_current")


@query
def case_cohort(s: CohortStudy) -> DataFrame:
    return s.cases(ALL).select(*COHORT_COLUMNS, "reason", "time_to_trigger", "diagnosis_year",
                               "diagnosis_bracket")


@query
def age_brackets(s: CohortStudy) -> DataFrame:
    people = s.event_frame()
    return people.groupBy(age_bracket(F.col("potential_age")).alias("bracket")) \
        .agg(count_records(people).alias("people"))


@query
def extra_only(s: CohortStudy) -> DataFrame:
    return s.extra_only(ALL).select(*COHORT_COLUMNS)


@query
def code_totals(s: CohortStudy) -> DataFrame:
    return s.code_totals()


# questionnaire and register

@query
def partial_dates(s: CohortStudy) -> DataFrame:
    return responses.typed_answers(s.tables["questionnaire"], CFG).select(
        "user_id", "group_id", "onset_year", "onset_month", "onset_date", "diagnosis_year",
        "diagnosis_month", "diagnosis_date")


@query
def questionnaire_decode(s: CohortStudy) -> DataFrame:
    return responses.typed_answers(s.tables["questionnaire"], CFG).select(
        "user_id", "group_id", "type_now", "now_year", "now_month", "now_date",
        "type_at_diagnosis")


def _latest(s: CohortStudy, part: str) -> DataFrame:
    return responses.latest_part(s.answers(), part).withColumn("completed", F.to_date("completed"))


@query
def latest_response(s: CohortStudy) -> DataFrame:
    return _latest(s, "now")


@query
def latest_onset(s: CohortStudy) -> DataFrame:
    return _latest(s, "onset")


@query
def latest_diagnosis(s: CohortStudy) -> DataFrame:
    return _latest(s, "diagnosis")


@query
def singleton_groups(s: CohortStudy) -> DataFrame:
    return register.valid_users(s.register_demographics(), s.answers())


PROFILE_COLUMNS = ("person_id", "gender", "birth_date", "age_current", "potential_date",
                   "type_now", "now_date", "onset_date", "age_onset", "age_onset_known",
                   "type_at_diagnosis", "diagnosis_date", "age_diagnosis")


@query
def register_profile(s: CohortStudy) -> DataFrame:
    return records(s.register_profile(ALL)).select(*PROFILE_COLUMNS,
                                          F.to_date("submitted").alias("submitted"))


@query
def match_miss(s: CohortStudy) -> DataFrame:
    return s.match_miss(ALIVE).select(
        *PROFILE_COLUMNS, "diagnosis_year", "diagnosis_age", "diagnosis_age_known", "sub_group",
        "all_group")


@query
def register_profile_in_region(s: CohortStudy) -> DataFrame:
    return records(s.register_profile(ALL, in_region=True)).select(*PROFILE_COLUMNS)


@query
def register_profile_unfiltered(s: CohortStudy) -> DataFrame:
    return records(s.register_profile(ALL, diagnosed_only=False)).select(*PROFILE_COLUMNS)


# a region of some of the areas
NARROW = replace(CFG, region_prefix="A0")


@query
def register_profile_narrow_region(s: CohortStudy) -> DataFrame:
    members = identity.register_cohort(s.tables["register_link"], NARROW)
    return records(register.register_profile(s.people(), members, s.answers(), CFG)) \
        .select(*PROFILE_COLUMNS)


@query
def register_diagnosed(s: CohortStudy) -> DataFrame:
    return s.register_diagnosed().select("person_id", "diagnosis_date", "age_diagnosis")


@query
def register_type_tallies(s: CohortStudy) -> DataFrame:
    return register.type_tallies(s.register_profile(ALL))


@query
def usable_users(s: CohortStudy) -> DataFrame:
    return register.usable_users(register.valid_users(s.register_demographics(), s.answers()))


# a cohort by another rule, compared with the same register profile
LOOSER = replace(CFG, min_events=2, min_gap_days=30)
MATCH_COLUMNS = (*PROFILE_COLUMNS, "diagnosis_year", "diagnosis_age", "diagnosis_age_known",
                 "sub_group", "all_group")


@query
def match_miss_cohort(s: CohortStudy) -> DataFrame:
    return records(register.match_miss(s.register_profile(ALIVE), s.other_cases(LOOSER), "Looser")) \
        .select(*MATCH_COLUMNS)


# a rule that few meet, so that some of the study's own cases are missed
STRICTER = replace(CFG, min_events=8, min_gap_days=700)


@query
def match_miss_stricter(s: CohortStudy) -> DataFrame:
    return records(register.match_miss(s.register_profile(ALIVE), s.other_cases(STRICTER),
                                       "Stricter")).select(*MATCH_COLUMNS)


@query
def match_miss_known_type(s: CohortStudy) -> DataFrame:
    return records(register.match_miss(s.register_profile(ALIVE), s.other_cases(LOOSER), "Looser",
                                       known_type_only=True)).select(*MATCH_COLUMNS)


@query
def register_group_tests(s: CohortStudy) -> DataFrame:
    return describe.group_tests(s.register_comparison(), "all_group", ACCURACY_AGES,
                                ACCURACY_LEVELS)


ACCURACY_AGES = ["age_onset", "diagnosis_age", "age_diagnosis", "age_end", "age_death"]
ACCURACY_LEVELS = ["gender", "type_at_diagnosis_group", "type_now_group", "age_onset_known",
                   "diagnosis_age_known", "age_diagnosis_known"]


@query
def accuracy_table(s: CohortStudy) -> DataFrame:
    return describe.describe(
        s.register_comparison(), "all_group", ACCURACY_AGES, ACCURACY_LEVELS,
        hide_level="Missing")


# clinic list

@query
def clinic_first_diagnosis(s: CohortStudy) -> DataFrame:
    return s.first_diagnosis()


@query
def area_compare(s: CohortStudy) -> DataFrame:
    return clinic.area_compare(s.flags())


@query
def site_check(s: CohortStudy) -> DataFrame:
    return clinic.site_tally(s.site_check())


@query
def site_admissions(s: CohortStudy) -> DataFrame:
    return clinic.site_admissions(clinic.site_check_ids(s.flags()), s.tables["inpatient_spell"],
                                  s.tables["provider_unit"], CFG)


@query
def core_admissions(s: CohortStudy) -> DataFrame:
    t = s.tables
    return clinic.core_admissions(t["inpatient_spell"], t["inpatient_episode"],
                                  t["inpatient_diagnosis"], t["provider_unit"], CODES, CFG)


@query
def disagreement_breakdown(s: CohortStudy) -> DataFrame:
    return records(s.disagreement()).select(
        "person_id", "group", "in_site", "site_date", "elsewhere_date", "gender", "age_current",
        "potential_age", "core_gp_count", "core_hospital_count")


@query
def cohort_summary(s: CohortStudy) -> DataFrame:
    """Not-listed people with primary-care events only."""
    return clinic.summarise(s.flags().where(clinic.NOT_LISTED_GP_ONLY), "gender",
                            ["age_current", "potential_age", "core_gp_count"])


@query
def recent_site_summary(s: CohortStudy) -> DataFrame:
    """Disagreements last admitted at the sites in recent years."""
    recent = s.disagreement().where(F.year("site_date") >= CFG.recent_site_year)
    return clinic.summarise(recent, "gender", ["age_current", "potential_age", "core_gp_count",
                                               "core_hospital_count"])


@query
def attrition(s: CohortStudy) -> DataFrame:
    return s.attrition()


@query
def confusion_matrix(s: CohortStudy) -> DataFrame:
    return s.confusion()


@query
def frame_equal(s: CohortStudy) -> DataFrame:
    """True negatives derived from either side: size of each and rows that differ."""
    return clinic.compare_true_negatives(s.flags())


# description

@query
def table_one(s: CohortStudy) -> DataFrame:
    return s.table_one(ALL)


@query
def group_tests(s: CohortStudy) -> DataFrame:
    people = s.people().join(s.location(), "person_id").where("board IS NOT NULL")
    return describe.group_tests(people, "board", ["age_current", "potential_age", "core_count"],
                                ["gender", "dead", "is_case"])


@query
def matched_ages(s: CohortStudy) -> DataFrame:
    """Ages by register and clinic group, in report order."""
    return describe.mean_sd_text(describe.with_order(s.stage_ages(), "group", STAGE_AGE_GROUPS)) \
        .select("group_order", "group", "variable", "shown")


QUERIES["scan_coded_events"] = QUERIES.pop("scan_coded_events_query")
