"""Null, tie and fan-out cases of single operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortspark.codes import COUNTED_CONCEPTS, default_codeset
from cohortspark.config import StudyConfig
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
from tests.clinical import d, frames, gp, study_rows

CFG = StudyConfig(area_name="North", site_units=("A1", "A2"))


@pytest.fixture(scope="module")
def tables(spark):
    return frames(spark, **study_rows())


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_resolve_identities(tables):
    got = tuples(identity.resolve_identities(tables["person_source"], CFG), "person_id", "gender_cd")
    # 6 has a known and a missing birth date; 7 has two genders; 8's second record is untrusted
    assert got == [(1, 2), (2, 1), (3, 2), (4, 1), (5, 2), (7, 3), (8, 1), (9, 2)]


def test_register_cohort_drops_repeated_ids(spark):
    links = frames(spark, register_link=[
        (1, 11, 1, d("1960-01-01"), 1, "W1"), (2, 12, 1, d("1960-01-01"), 1, "E1"),
        (3, 13, 4, d("1960-01-01"), 1, "W1"), (4, 13, 4, d("1960-01-01"), 2, "W1"),
        (5, 14, 99, d("1960-01-01"), 1, "W1"), (6, 15, 39, None, 1, "W1"),
        (7, 15, 39, None, 1, "W1")])["register_link"]
    assert tuples(identity.register_cohort(links, CFG), "person_id") == [(11,), (15,)]
    assert tuples(identity.register_cohort(links, CFG, in_region=False), "person_id") == \
        [(11,), (12,), (15,)]


def test_reconcile_prefers_the_record_only_on_disagreement(spark):
    demo = spark.createDataFrame(
        [(1, 1, d("1960-01-01"), 1), (2, 2, None, 1), (None, 3, d("1970-01-01"), 1),
         (4, 4, d("1980-01-01"), 1)],
        "person_id long, user_id long, birth_date date, gender_cd int")
    pop = spark.createDataFrame([(1, d("1961-01-01")), (2, d("1962-01-01")), (4, None)],
                                "person_id long, birth_date date")
    got = identity.reconcile_birth_dates(demo, pop)
    assert {r.user_id: r.birth_date for r in got.collect()} == {
        1: d("1961-01-01"), 2: None, 3: d("1970-01-01"), 4: d("1980-01-01")}
    ids = identity.with_surrogate_ids(demo)
    assert {r.user_id: r.person_id for r in ids.collect()} == {1: 1, 2: 2, 3: -3, 4: 4}


def test_tagging_over_all_sources(tables):
    got = tuples(events.tag_all_sources(tables, default_codeset(), CFG).where("person_id = 4"),
                 "source", "concept", "code")
    # without a fourth character the code counts for onset, not for the named concept
    assert got == [("GP", "extra", None), ("GP", "optic_neuritis", "F4H3."),
                   ("HOSPITAL", "extra", None), ("HOSPITAL", "extra", None),
                   ("HOSPITAL", "optic_neuritis", "H46X")]


def test_inpatient_chain_needs_the_episode(tables):
    got = events.tag_all_sources(tables, default_codeset(), CFG).where("source = 'HOSPITAL'")
    # spell 11 has a core diagnosis on an episode that does not exist
    assert tuples(got.where("person_id IN (1, 2)"), "person_id", "concept") == \
        [(1, "nmo"), (2, "core")]


def test_each_source_is_scanned_with_its_codes(spark, tmp_path, capsys):
    path = str(tmp_path / "gp")
    frames(spark, gp_event=[gp(1, "2001-01-01", "F20..")])["gp_event"].write.parquet(path)
    events.gp_events(spark.read.parquet(path), default_codeset(), CFG).explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    pushed = next(line for line in lines if "PushedFilters" in line)
    assert "In(code, [" in pushed and "GreaterThanOrEqual(event_date" in pushed
    assert next(line for line in lines if "ReadSchema" in line).endswith(
        "struct<person_id:bigint,event_date:date,code:string>")


def test_death_cascade_takes_one_source_per_person(spark):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "person_id long, death_date date")

    first = rows((1, d("2001-01-01")), (1, d("2002-01-01")), (1, d("2002-01-01")), (2, None))
    second = rows((1, d("1999-01-01")), (3, d("2003-01-01")))
    third = rows((2, d("2004-01-01")), (3, d("2001-01-01")), (4, d("2006-01-01")),
                 (4, d("2005-01-01")), (None, d("2005-01-01")))
    sources = [deaths.DeathSource("A", first), deaths.DeathSource("B", second),
               deaths.DeathSource("C", third, first_only=True)]
    got = deaths.death_cascade(sources)
    assert tuples(deaths.death_records(got), "person_id", "death_date", "death_source") == [
        (1, date(2001, 1, 1), "A"), (1, date(2002, 1, 1), "A"), (1, date(2002, 1, 1), "A"),
        (2, None, "A"), (3, date(2003, 1, 1), "B"), (4, date(2005, 1, 1), "C")]
    once = deaths.death_cascade(sources, dedupe=True)
    assert tuples(once, "person_id", "death_date", "copies") == [
        (1, date(2001, 1, 1), 1), (2, None, 1), (3, date(2003, 1, 1), 1),
        (4, date(2005, 1, 1), 1)]


def test_code_discovery(spark):
    t = frames(spark, dictionary_a=[("9411.", "died"), ("94H..", "no"), ("22J..", "dead")],
               dictionary_b=[("9411.", "died", "x"), ("94A11", None, "short"), ("9401.", "n", "n")])
    found = deaths.discover_codes(deaths.code_dictionary(t["dictionary_a"], t["dictionary_b"]))
    assert tuples(found, "code", "description") == [
        ("22J..", "dead"), ("9411.", "died"), ("94A11", "short")]


def event_rows(spark, *rows):
    return spark.createDataFrame(
        [(p, d(day), s, c, code) for p, day, s, c, code in rows],
        "person_id long, event_date date, source string, concept string, code string")


def death_rows(spark, *rows):
    return spark.createDataFrame([(p, d(day), n) for p, day, n in rows],
                                 "person_id long, death_date date, copies long")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, d("2000-01-02"), 1), (2, d("1990-01-01"), 2), (3, None, 1)],
        "person_id long, birth_date date, gender_cd int")


def test_valid_events_bounds(spark, people):
    rows = event_rows(spark, (1, "2000-01-01", "GP", "core", None),
                      (1, "1999-12-31", "GP", "core", None),
                      (2, "2010-01-01", "GP", "core", None),
                      (2, "2010-01-02", "GP", "core", None),
                      (3, "2010-01-01", "GP", "core", None),
                      (9, "2010-01-01", "GP", "core", None))
    got = events.valid_events(rows, people, death_rows(spark, (2, "2010-01-01", 1)))
    # one day before birth rounds to age zero; an event on the day of death is kept
    assert tuples(got, "person_id", "event_date", "event_age") == [
        (1, date(2000, 1, 1), 0.0), (2, date(2010, 1, 1), 20.0)]


def test_death_fan_out_counts_records(spark, people):
    rows = event_rows(spark, (2, "2010-01-01", "GP", "core", None))
    records = death_rows(spark, (2, "2011-01-01", 2), (2, "2012-01-01", 1))
    fanned = events.valid_events(rows, people, records)
    assert fanned.count() == 2
    assert tuples(events.count_by_source(fanned), "gp_count", "hospital_count") == [(3, 0)]
    single = events.valid_events(rows, people, death_rows(spark, (2, "2011-01-01", 1)))
    assert tuples(events.count_by_source(single), "gp_count") == [(1,)]


def test_nth_event_counts_sources_of_one_day_apart(spark, people):
    rows = event_rows(spark, (2, "2010-01-01", "GP", "core", None),
                      (2, "2010-01-01", "HOSPITAL", "core", None),
                      (2, "2011-01-01", "GP", "core", None))
    valid = events.valid_events(rows, people, death_rows(spark))
    assert tuples(timeline.nth_event(valid, 3), "person_id", "nth_date") == [(2, date(2011, 1, 1))]
    assert timeline.nth_event(valid, 4).count() == 0
    assert tuples(timeline.person_features(valid), "core_event_3_date", "core_gp_count",
                  "nmo_gp_count") == [(date(2011, 1, 1), 2, 0)]


def test_first_contact_starts_a_year_early(spark):
    rows = frames(spark, gp_event=[
        gp(1, "1968-12-31", "a", "1960-01-01"), gp(1, "1969-01-01", "a", "1960-01-01"),
        gp(2, "1980-01-01", "a", "1981-01-01"), gp(3, "1980-01-01", "a", status=99),
        gp(None, "1980-01-01", "a")])["gp_event"]
    assert tuples(timeline.first_contact(rows, CFG), "person_id", "first_contact") == \
        [(1, date(1969, 1, 1))]


@pytest.mark.parametrize("onset, count, core, verdict", [
    ("2000-06-28", 2, "2000-06-28", 0), ("2000-06-29", 2, "2000-06-29", 1),
    ("2000-01-02", 3, "2000-01-02", 1), ("2000-06-29", 2, None, 0), (None, None, None, 0)])
def test_case_rule(spark, onset, count, core, verdict):
    frame = spark.createDataFrame(
        [(d(onset), d("2000-01-01"), count, d(core))],
        "potential_date date, first_contact date, core_count long, core_date date")
    assert cohort.classify_cases(frame, CFG).first()["is_case"] == verdict


def test_case_rule_without_first_contact(spark):
    frame = spark.createDataFrame(
        [(d("2001-01-01"), None, 2, d("2001-01-01")), (d("2001-01-01"), None, 3, d("2001-01-01"))],
        "potential_date date, first_contact date, core_count long, core_date date")
    assert [r.is_case for r in cohort.classify_cases(frame, CFG).collect()] == [0, 1]


def test_resident_and_latest_location(spark):
    t = frames(spark,
               residence=[(1, d("2000-01-01"), d("9999-01-01"), 1),
                          (2, d("2000-01-01"), d("2020-12-30"), 1),
                          (3, d("2021-01-01"), d("9999-01-01"), 1),
                          (4, d("2000-01-01"), d("2020-12-31"), 1),
                          (5, d("2000-01-01"), d("9999-01-01"), 0),
                          (1, d("2001-01-01"), d("9999-01-01"), 1)],
               residence_area=[(1, d("2000-01-01"), d("2001-01-01"), "W1", 1),
                               (1, d("1999-01-01"), None, "W2", 1),
                               (2, d("2000-01-01"), d("2001-01-01"), "W9", 1),
                               (2, d("2000-01-01"), d("2001-01-01"), "W1", 1),
                               (2, d("2021-01-01"), d("9999-01-01"), "W5", 1),
                               (3, d("2000-01-01"), d("2001-01-01"), None, 1)])
    assert tuples(residence.resident_at_end(t["residence"], CFG), "person_id") == [(1,), (4,)]
    # a missing end is the latest; equal dates go to the smaller area
    assert tuples(residence.latest_location(t["residence_area"], CFG), "person_id", "area_code") \
        == [(1, "W2"), (2, "W1")]


def test_latest_answers(spark):
    def form(user, day, group, **answers):
        names = ["onset_year", "onset_month", "now_year", "now_month", "now_unsure",
                 "now_primary", "now_relapsing", "now_secondary", "diagnosis_year",
                 "diagnosis_month", "type_at_diagnosis"]
        return (user, date.fromisoformat(day) and __import__("datetime").datetime.fromisoformat(day),
                group, *(answers.get(n, "NA") for n in names))

    t = frames(
        spark,
        questionnaire=[
            form(1, "2015-01-01", 1, now_relapsing="1"),
            form(1, "2016-01-01", 1, now_primary="0", diagnosis_year="2000"),
            form(1, "2016-01-01", 2, now_relapsing="4", diagnosis_year="2001",
                 diagnosis_month=None, onset_year="1930", onset_month="0"),
            form(2, "2016-01-01", 1, now_secondary="2", type_at_diagnosis="7")],
        register_link=[(1, 11, 1, d("1960-01-01"), 1, "W1"), (2, 12, 99, d("1960-01-01"), 1, "W1")])
    people = identity.register_demographics(t["register_link"], CFG)
    got = responses.latest_answers(t["questionnaire"], people, CFG)
    assert tuples(got, "person_id", "type_now", "diagnosis_date", "age_onset", "age_onset_known",
                  "type_at_diagnosis") == [
        (-2, "SPMS", None, None, "Missing", "Unknown"),
        (11, "Benign/RRMS", date(2001, 1, 1), None, "Missing", "Unknown")]


def test_match_miss_both_ways(spark):
    profile = spark.createDataFrame(
        [(1, 1, 2000, 40.5, "RRMS"), (1, 1, 2000, 40.5, "RRMS"), (2, 0, 2001, 30.0, "Unknown"),
         (3, 0, None, None, "PPMS")],
        "person_id long, is_case int, potential_year int, potential_age double, "
        "type_at_diagnosis string")
    cases = profile.where("is_case = 1").selectExpr(
        "person_id", "potential_year AS diagnosis_year", "potential_age AS diagnosis_age")
    own = register.match_own_cases(profile, "G")
    joined = register.match_miss(profile, cases, "G")
    columns = ["person_id", "diagnosis_year", "diagnosis_age", "diagnosis_age_known", "all_group"]
    assert tuples(own, *columns) == tuples(joined, *columns)
    assert own.count() == profile.count()
    assert register.match_miss(profile, cases, "G", known_type_only=True).count() == 3
    assert register.match_own_cases(profile, "G", "All").count() == 8


def test_match_miss_sides_run_in_tasks_of_their_own(spark):
    profile = spark.createDataFrame([(1, "RRMS"), (1, "RRMS"), (2, "PPMS"), (None, "PPMS")],
                                    "person_id long, type_at_diagnosis string")
    cases = spark.createDataFrame([(1, 2000, 40.5), (1, 2000, 40.5), (3, 2001, 30.0), (None, 2001, 30.0)],
                                  "person_id long, diagnosis_year int, diagnosis_age double")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        # both sides are dealt by person already, as the study's are
        got = register.match_miss(profile.repartition("person_id"), cases.repartition("person_id"), "G")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = tuples(got, "person_id", "diagnosis_year", "sub_group")
    finally:
        for k in off:
            spark.conf.unset(k)
    assert plan.count("Exchange hashpartitioning(_person#") == 2
    assert got.columns == ["person_id", "type_at_diagnosis", "diagnosis_year", "diagnosis_age", "sub_group",
                           "diagnosis_age_known", "group", "all_group"]
    assert found == [(1, 2000, register.FOUND), (1, 2000, register.FOUND), (2, None, register.MISSED),
                     (None, None, register.MISSED)]


def test_site_check_flag_wins_per_person(spark):
    ids = spark.createDataFrame([(1, "B"), (1, "A"), (2, "A"), (3, "A")],
                                "person_id long, `group` string")
    spells = frames(spark, inpatient_spell=[
        ("RYC", 1, 1, None, None, 1), ("A1", 2, 1, None, None, 1), ("RYC", 3, 2, None, None, 1),
        (None, 4, 2, None, None, 1)])["inpatient_spell"]
    got = clinic.site_check(ids, spells, CFG)
    assert tuples(got, "person_id", "group", "in_site") == [(1, "A", 1), (2, "A", 0)]


def test_first_diagnosis_keeps_unlinked_as_one(spark):
    t = frames(spark,
               clinic_link=[(1, 11, None, "W1", 1), (2, None, None, "E1", 1), (3, None, None, "W1", 1)],
               clinic_details=[(1, "OTHER", d("2005-01-01"), None), (1, "MS", d("2004-01-01"), None),
                               (2, "MS", None, None), (3, "MS", d("2001-01-01"), None)],
               area_lookup=[("W1", "D1", 1), ("W1", "D0", 0), ("E1", "D2", 1)])
    got = clinic.first_diagnosis(t["clinic_link"], t["clinic_details"], t["area_lookup"], CFG)
    assert tuples(got, "person_id", "diagnosis", "diagnosis_date", "district_code") == [
        (11, "MS", date(2004, 1, 1), "D1"), (None, "MS", date(2001, 1, 1), "D1")]


def test_summary_is_null_when_a_value_is_missing(spark):
    people = spark.createDataFrame([("Female", 1.0, 2.0), ("Male", 2.0, None)],
                                   "gender string, a double, b double")
    got = clinic.summarise(people, "gender", ["a", "b"]).first().asDict()
    assert got == {"female": 1, "mean_a": 1.5, "sd_a": 0.7, "mean_b": None, "sd_b": None}


def test_describe_and_tests(spark):
    df = spark.createDataFrame(
        [("x", 1.0, "Present"), ("x", 3.0, "Missing"), ("y", 5.0, "Present"), ("y", None, None)],
        "g string, v double, c string")
    got = describe.describe(df, "g", ["v"], ["c"], hide_level="Missing")
    assert tuples(got, "group", "variable", "level", "n", "pct", "mean", "sd") == [
        ("x", "c", "Present", 1, 50.0, None, None), ("x", "v", None, 2, None, 2.0, 1.4142),
        ("y", "c", "Present", 1, 100.0, None, None), ("y", "v", None, 1, None, 5.0, None)]
    tests = {r.variable: r for r in describe.group_tests(df, "g", ["v"], ["c"]).collect()}
    # between = 2*(2-3)^2 + 1*(5-3)^2 = 6, within = 2, on 1 and 1 degrees of freedom
    assert (tests["v"].statistic, tests["v"].df1, tests["v"].df2) == (3.0, 1, 1)
    # table [[1, 1], [0, 1]]: 3 * (1/2 + 1/4 + 1/2 - 1)
    assert (tests["c"].statistic, tests["c"].df1) == (0.75, 1)


def test_person_counts_fill(spark, people):
    contact = spark.createDataFrame([(1, d("2000-01-01")), (2, d("2000-01-01"))],
                                    "person_id long, first_contact date")
    rows = event_rows(spark, (2, "2010-01-01", "GP", "core", None))
    features = timeline.person_features(events.valid_events(rows, people, death_rows(spark)))
    unknown = people.withColumn("gender_cd", F.when(F.col("person_id") == 2, 2))
    got = person.person_counts(unknown, contact, features)
    assert tuples(got, "person_id", "core_gp_count", "gender") == [(1, 0, "0"), (2, 1, "Female")]
    strict = person.person_counts(unknown, contact, features, faithful=False)
    assert tuples(strict, "person_id", "gender") == [(1, None), (2, "Female")]


def test_literal_prefixes():
    assert deaths.literal_prefixes([r"^5O[A].{2}$", r"^22J?.$", r"^94"]) == ["5O", "22", "94"]
    assert deaths.literal_prefixes([r"^94", r"22J"]) == []
    assert deaths.literal_prefixes([r"^94|95"]) == []


def test_chi_squared_statistic(spark):
    cells = {("x", "a"): 10, ("x", "b"): 20, ("y", "a"): 20, ("y", "b"): 10}
    rows = [(g, c) for (g, c), n in cells.items() for _ in range(n)] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    # statistic 60 * (100 - 400)^2 / 30^4 = 6.667 on one degree of freedom
    assert describe.group_tests(df, "g", [], ["c"]).first().statistic == 6.6667


def test_empty_population_keeps_its_total(spark):
    counts = spark.createDataFrame([(1, *([0] * 2 * len(COUNTED_CONCEPTS)))], "person_id long, " + ", ".join(
        f"{c}_{s}_count long" for c in COUNTED_CONCEPTS for s in ("gp", "hospital")))
    members = spark.createDataFrame([(1, True)], "person_id long, everyone boolean")
    for some in (members, members.where("false")):
        rows = cohort.code_totals(counts.join(some, "person_id"), {"everyone": "Everyone"}).collect()
        assert [tuple(r) for r in rows] == [("Everyone", cohort.GRAND_TOTAL, 0)]


# one person, user or unit holding most rows


def test_hot_person_is_bounded_by_days(spark):
    """A person with very many repeated events reaches the window as one row per day."""
    hot = spark.range(60_000).selectExpr(
        "IF(id % 3 < 2, 1L, id) AS person_id",
        "date_add(DATE'2000-01-01', CAST(id % 10 AS INT)) AS event_date",
        "'F20..' AS code")
    tagged = events.union_sources(events.gp_events(hot, default_codeset(), CFG))
    assert tagged.where("person_id = 1").count() == 10
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "HashAggregate" in plan[shuffle:]
    everyone = tagged.select("person_id").distinct().selectExpr(
        "person_id", "DATE'1960-01-01' AS birth_date", "1 AS gender_cd")
    valid = events.valid_events(tagged, everyone, death_rows(spark))
    features = timeline.person_features(valid).where("person_id = 1").first()
    assert features.core_gp_count == 10 and features.core_event_7_date == date(2000, 1, 7)


def test_hot_user_and_unlinked_records(spark):
    """One user with most questionnaires, and a third of the register unlinked."""
    forms = spark.range(30_000).selectExpr(
        "IF(id % 3 < 2, 1L, id) AS user_id",
        "timestamp_seconds(id) AS completed", "id AS group_id", "CAST(id % 50 + 1970 AS STRING) AS y")
    raw = frames(spark)["questionnaire"].drop("user_id", "completed", "group_id")
    raw = forms.selectExpr("user_id", "completed", "group_id",
                           *(f"y AS {c}" if c == "diagnosis_year" else f"'NA' AS {c}"
                             for c in raw.columns))
    people = spark.range(30_000).selectExpr(
        "id AS user_id", "IF(id % 3 = 2, NULL, id + 100000) AS person_id",
        "DATE'1950-01-01' AS birth_date", "1 AS gender_cd")
    got = responses.latest_answers(raw, people, CFG)
    users = forms.select("user_id").distinct().count()
    assert got.count() == users
    # the last form of user 1 is number 29998
    row = got.where("user_id = 1").first()
    assert row.group_id == 29998 and row.diagnosis_date.year == 29998 % 50 + 1970
    assert got.where("person_id < 0").count() == users - 1
