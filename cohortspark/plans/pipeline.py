"""The study end to end: from input tables to person frame, cohorts and comparisons.

Every step is a lazy DataFrame, built on first use.  With a stage store the
steps named in ``STAGES`` are written once and read back, which shortens plans
and survives lost executors; without one a result is a single plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.codes import DEATH_CODE_PATTERNS, CodeSet, default_codeset
from cohortspark.config import StudyConfig
from cohortspark.functions.rows import records, truthy
from cohortspark.operators import (
    clinic,
    cohort,
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
from cohortspark.sources.stages import StageStore, input_identity

STAGES = ("persons", "deaths", "tagged", "features", "base", "counts", "people", "alive",
          "answers", "flags")
ALL, ALIVE = "all", "alive"
REGISTER_GROUP, WHOLE_REGISTER = "Algorithm", "All Register Population"
STAGE_AGE_GROUPS = ("Register (All)", "Clinic List (All)", "Register (Matched)",
                    "Clinic List (Matched)")


class CohortStudy:
    """One study over a set of input tables."""

    def __init__(self, tables: Mapping[str, DataFrame], cfg: StudyConfig | None = None,
                 codeset: CodeSet | None = None,
                 death_patterns: Sequence[str] = DEATH_CODE_PATTERNS,
                 stages: StageStore | None = None, refresh: bool = False) -> None:
        self.tables = tables
        self.cfg = cfg or StudyConfig()
        self.codeset = codeset or default_codeset()
        self.death_patterns = tuple(death_patterns)
        # stages of another configuration, code set or input are never taken for this study's
        self.stages = stages and stages.keyed(self.cfg, self.codeset, self.death_patterns,
                                              input_identity(tables))
        self.refresh = refresh
        self._built: dict[str, DataFrame] = {}

    def _step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            if self.stages is not None and name in STAGES:
                self._built[name] = self.stages.run(name, build, self.refresh)
            else:
                self._built[name] = build()
        return self._built[name]

    # extraction and cleaning

    def persons(self) -> DataFrame:
        return self._step("persons", lambda: identity.resolve_identities(
            self.tables["person_source"], self.cfg))

    def deaths(self) -> DataFrame:
        return self._step("deaths", lambda: deaths.all_deaths(
            self.tables, self.cfg, self.death_patterns))

    def tagged(self) -> DataFrame:
        return self._step("tagged", lambda: events.tag_all_sources(
            self.tables, self.codeset, self.cfg))

    def valid(self) -> DataFrame:
        """Valid events, each with the number of death dates and records it counts for."""
        return self._step("valid", lambda: events.weighted_events(
            self.tagged(), self.persons(), self.deaths()))

    def valid_records(self) -> DataFrame:
        """Valid events with a row per death date."""
        return events.valid_events(self.tagged(), self.persons(), self.deaths())

    def contact(self) -> DataFrame:
        return self._step("contact", lambda: timeline.first_contact(
            self.tables["gp_event"], self.cfg))

    def features(self) -> DataFrame:
        return self._step("features", lambda: timeline.person_features(self.valid()))

    # locations

    def residents(self) -> DataFrame:
        return self._step("residents", lambda: residence.resident_at_end(
            self.tables["residence"], self.cfg))

    def location(self) -> DataFrame:
        def build() -> DataFrame:
            latest = residence.latest_location(self.tables["residence_area"], self.cfg)
            return residence.with_board(latest, self.tables["area_lookup"],
                                        self.tables["board_lookup"], self.cfg)
        return self._step("location", build)

    def household(self) -> DataFrame | None:
        if not self.cfg.household_location:
            return None

        def build() -> DataFrame:
            latest = residence.latest_location(
                self.tables["residence_household"], self.cfg, ("area_code", "household_id"))
            located = residence.with_board(latest, self.tables["area_lookup"],
                                           self.tables["board_lookup"], self.cfg)
            return located.withColumnsRenamed({
                "area_code": "household_area_code", "district_code": "household_district_code",
                "board": "household_board", "location_start": "household_start",
                "location_end": "household_end"})
        return self._step("household", build)

    # one row per person

    # Up to the flags, rows carry ``copies``: the number of death records they stand for.

    def base(self) -> DataFrame:
        return self._step("base", lambda: person.person_base(
            self.persons(), self.contact(), self.deaths(), self.cfg))

    def event_frame(self) -> DataFrame:
        return self._step("event_frame", lambda: person.person_frame(
            self.base(), self.features()))

    def frame(self) -> DataFrame:
        """The person master frame, a row per death record."""
        return self._step("frame", lambda: records(self._placed(self.event_frame())))

    def _placed(self, people: DataFrame) -> DataFrame:
        return person.with_places(people, self.location(), self.household())

    def counts(self) -> DataFrame:
        return self._step("counts", lambda: person.person_counts(
            self.persons(), self.contact(), self.features()))

    def people(self) -> DataFrame:
        """The cleaned, classified population, without places."""
        return self._step("people", lambda: cohort.classify_cases(
            person.clean_population(self.event_frame(), self.cfg), self.cfg))

    def classified(self) -> DataFrame:
        """The cleaned, classified population with places."""
        return self._step("classified", lambda: records(self._placed(self.people())))

    def alive(self) -> DataFrame:
        return self._step("alive", lambda: person.alive_resident(
            self.people(), self.residents()))

    def located_alive(self) -> DataFrame:
        return self.alive().join(self.location(), "person_id", "left")

    def _weighted(self, which: str) -> DataFrame:
        return self.alive() if which == ALIVE else self.people()

    def population(self, which: str = ALIVE) -> DataFrame:
        """Everyone, or the people alive and resident at the end of the study."""
        return records(self._weighted(which))

    def cases(self, which: str = ALIVE) -> DataFrame:
        return records(cohort.case_cohort(self._weighted(which), self.cfg))

    def extra_only(self, which: str = ALIVE) -> DataFrame:
        return records(cohort.extra_only(self._weighted(which)))

    def memberships(self) -> DataFrame:
        """Per person: event counts, and in the population, alive and resident, with extra codes only.

        Counts and onsets come from one pass over the features.
        """
        counted = person.person_frame(self.base(), self.features(), person.COUNT_COLUMNS)
        people = person.clean_population(counted, self.cfg)
        resident = self.residents().withColumn("_resident", F.lit(True))
        alive = (F.col("dead") == 0) & F.col("_resident")
        extra = F.col("core_date").isNull() & F.col("potential_date").isNotNull()
        return people.join(resident, "person_id", "left").groupBy("person_id").agg(
            *(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in person.COUNT_COLUMNS),
            F.lit(True).alias("everyone"), F.bool_or(alive).alias("alive"),
            F.bool_or(extra).alias("extra"), F.bool_or(alive & extra).alias("extra_alive"))

    def code_totals(self) -> DataFrame:
        return cohort.code_totals(self.memberships(), {
            "everyone": "Everyone", "alive": "Alive", "extra": "Extra Codes Only",
            "extra_alive": "Extra Codes Only (Alive)",
        }, without_total=("extra", "extra_alive"))

    # register

    def register_demographics(self) -> DataFrame:
        """Register records with birth dates reconciled against the whole population.

        Who is in the population does not depend on events or places, so those
        are left out of this branch.
        """
        return self._step("register_demographics", lambda: identity.reconcile_birth_dates(
            identity.register_demographics(self.tables["register_link"], self.cfg),
            person.plausible(self.base(), self.cfg)))

    def answers(self) -> DataFrame:
        """Latest questionnaire answers per person."""
        return self._step("answers", lambda: responses.latest_answers(
            self.tables["questionnaire"], self.register_demographics(), self.cfg))

    def register_members(self, in_region: bool = False) -> DataFrame:
        return self._step(f"members_{in_region}", lambda: identity.register_cohort(
            self.tables["register_link"], self.cfg, in_region=in_region).select("person_id"))

    def register_profile(self, which: str = ALIVE, diagnosed_only: bool = True,
                         in_region: bool = False) -> DataFrame:
        """Profiled members; rows carry ``copies``, as the population's do."""
        return self._step(f"profile_{which}_{diagnosed_only}_{in_region}",
                          lambda: register.register_profile(
                              self._weighted(which), self.register_members(in_region),
                              self.answers(), self.cfg, diagnosed_only))

    def register_diagnosed(self) -> DataFrame:
        """Members of the region whose own diagnosis lies in the study, in records or not."""
        told = responses.join_answers(self.register_members(in_region=True), self.answers())
        return responses.diagnosed_in_study(told, self.cfg)

    def other_cases(self, cfg: StudyConfig, which: str = ALIVE) -> DataFrame:
        """The cases of the same population by the rule of another configuration."""
        return cohort.case_cohort(cohort.classify_cases(self._weighted(which), cfg), cfg)

    def match_miss(self, which: str = ALIVE) -> DataFrame:
        return records(register.match_own_cases(self.register_profile(which), REGISTER_GROUP))

    def register_comparison(self, which: str = ALIVE) -> DataFrame:
        """Found, missed and whole register groups, stacked; rows carry ``copies``."""
        return register.with_progressive_groups(register.match_own_cases(
            self.register_profile(which), REGISTER_GROUP, WHOLE_REGISTER))

    def _with_register(self, people: DataFrame) -> DataFrame:
        """People with ``on_register`` (a member diagnosed in the study) and register ages."""
        member = self.register_members().withColumn("_member", F.lit(True))
        in_time = F.col("diagnosis_date").between(F.lit(self.cfg.diagnosis_min),
                                                  F.lit(self.cfg.diagnosis_max))
        return responses.join_answers(people.join(member, "person_id", "left"), self.answers()) \
            .withColumn("on_register", truthy(F.col("_member") & in_time)).drop("_member")

    def table_one(self, which: str = ALIVE) -> DataFrame:
        """Population, extra-only, register and case groups, which share people, described."""
        names = describe.TABLE_ONE_GROUPS
        potential = F.col("potential_age")
        extra = F.col("core_date").isNull() & F.col("potential_date").isNotNull()
        uncounted = {"core_gp_count": None, "core_hospital_count": None}
        groups = [
            describe.Group(names["population"], F.lit(True), {"diagnosis_age": None, **uncounted}),
            describe.Group(names["extra_only"], extra, {"diagnosis_age": potential, **uncounted}),
            describe.Group(names["register"], F.col("on_register"),
                           {"diagnosis_age": F.col("age_diagnosis"), **uncounted}),
            describe.Group(names["cases"], F.col("is_case") == 1, {"diagnosis_age": potential}),
        ]
        people = self._with_register(self._weighted(which)).withColumn(
            "dead", F.when(F.col("dead") == 1, "Dead").otherwise("Alive"))
        return describe.described(describe.overlapping_stats(
            people, groups,
            ["diagnosis_age", "age_death", "age_end", "core_gp_count", "core_hospital_count"],
            ["gender", "dead"]))

    # clinic list

    def first_diagnosis(self) -> DataFrame:
        return self._step("first_diagnosis", lambda: clinic.first_diagnosis(
            self.tables["clinic_link"], self.tables["clinic_details"],
            self.tables["area_lookup"], self.cfg))

    def flags(self) -> DataFrame:
        return self._step("flags", lambda: clinic.area_flags(
            self.located_alive(), self.first_diagnosis(), self.cfg))

    def site_dates(self) -> DataFrame:
        def build() -> DataFrame:
            admissions = clinic.core_admissions(
                self.tables["inpatient_spell"], self.tables["inpatient_episode"],
                self.tables["inpatient_diagnosis"], self.tables["provider_unit"],
                self.codeset, self.cfg)
            return clinic.last_site_dates(admissions, self.cfg)
        return self._step("site_dates", build)

    def site_check(self) -> DataFrame:
        return self._step("site_check", lambda: clinic.site_check(
            clinic.site_check_ids(self.flags()), self.tables["inpatient_spell"], self.cfg))

    def disagreement(self) -> DataFrame:
        """Algorithm-only people by last admission; rows carry ``copies``."""
        return clinic.disagreement_breakdown(self.flags(), self.site_dates(),
                                             self.tables["inpatient_spell"], self.cfg)

    def attrition(self) -> DataFrame:
        return clinic.attrition(self.flags(), self.site_dates())

    def confusion(self) -> DataFrame:
        """Algorithm against clinic list, among the people of the area."""
        return clinic.confusion(self.flags().where("in_area = 1"), "algorithm", "clinic_area")

    def stage_ages(self) -> DataFrame:
        """Ages by register and clinic group, all and matched, in one pass."""
        register_all, clinic_all, register_found, clinic_found = STAGE_AGE_GROUPS
        case, listed = F.col("is_case") == 1, F.col("clinic") == 1
        on_register = F.col("on_register")

        def group(label: str, condition: Column, onset: str, diagnosis: str) -> describe.Group:
            return describe.Group(label, condition, {
                "age_onset": F.col(onset), "age_diagnosis": F.col(diagnosis),
                "onset_to_diagnosis": F.col(diagnosis) - F.col(onset)})

        ages, list_ages = ("age_onset", "age_diagnosis"), ("list_age_onset", "list_age_diagnosis")
        people = self._with_register(self.flags()).withColumn(
            "potential_age", F.when(case, F.col("potential_age")))
        stats = describe.overlapping_stats(people, [
            group(register_found, on_register & case, *ages),
            group(register_all, on_register, *ages),
            group(clinic_found, listed & case, *list_ages),
            group(clinic_all, listed, *list_ages),
        ], ["age_current", "potential_age", "age_onset", "age_diagnosis", "onset_to_diagnosis"], [])
        return describe.described(stats, digits=1)
