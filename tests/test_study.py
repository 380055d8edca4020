"""The clinical study end to end, with stages, reports and invariants."""

import os

import pytest
from pyspark.sql import functions as F

from cohortspark.config import StudyConfig
from cohortspark.operators import clinic
from cohortspark.plans.pipeline import ALIVE, ALL, CohortStudy
from cohortspark.plans.queries import study
from cohortspark.sources import sinks, stages, tables
from tests.clinical import d, frames, study_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clinical(spark):
    return CohortStudy(frames(spark, **study_rows()), StudyConfig(area_name="North", site_units=("A1",)))


def test_who_is_a_case(clinical):
    got = {r.person_id: r.is_case for r in clinical.classified().collect()}
    # 6 is dropped for two birth dates, 7 for two genders, 9 for an implausible age
    assert set(got) == {1, 2, 3, 4, 5, 8}
    assert {p for p, v in got.items() if v} == {1, 2, 5}


def test_cohort_reasons(clinical):
    got = {r.person_id: (r.reason, r.time_to_trigger) for r in clinical.cases(ALL).collect()}
    assert got[1] == ("Over 6 Months From Earliest GP Entry", None)
    # third distinct event is the admission on 2000-04-01, 60 days after the first
    assert got[2] == ("3 or More Events", 0.16)


def test_person_frame_values(clinical):
    frame = clinical.frame().where("person_id = 5").collect()
    # two identical death records keep two rows, and double the event count
    assert len(frame) == 2 and frame[0].core_gp_count == 2 and frame[0].dead == 1
    assert frame[0].board == "North"
    first = clinical.frame().where("person_id = 1").first()
    assert first.nmo_last_date == d("2010-04-01") and first.family_history_date == d("2002-01-01")


def test_dedupe_deaths(spark):
    once = CohortStudy(frames(spark, **study_rows()), StudyConfig(dedupe_deaths=True))
    rows = once.frame().where("person_id = 5").collect()
    assert len(rows) == 1 and rows[0].core_gp_count == 1


def test_extra_only_and_alive(clinical):
    assert [r.person_id for r in clinical.extra_only(ALL).collect()] == [4]
    assert {r.person_id for r in clinical.population(ALIVE).collect()} == {1, 2, 3, 4, 8}


def test_household_is_optional(spark):
    study_ = CohortStudy(frames(spark, **study_rows()), StudyConfig(household_location=False))
    row = study_.frame().where("person_id = 1").first()
    assert row.household_id is None and row.area_code == "W01"


def test_code_totals(clinical):
    got = {(r.population, r.code_type): r.people for r in clinical.code_totals().collect()}
    assert got["Everyone", "core"] == 4
    assert got["Everyone", "optic_neuritis"] == 1
    assert got["Everyone", "Grand Total (All MS)"] == 5
    assert got["Alive", "core"] == 3
    assert not any(p.startswith("Extra") and t.startswith("Grand") for p, t in got)


@pytest.fixture(scope="module")
def star(spark):
    s = study(spark, SMALL)
    s.flags()
    return s


def test_confusion_cells_add_up(star):
    area = star.flags().where("in_area = 1").count()
    assert star.confusion().agg(F.sum("people")).first()[0] == area


def test_waterfall_only_falls(star):
    steps = [r.people for r in star.attrition().orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True)


def test_true_negatives_agree(star):
    assert clinic.true_negatives_two_ways(star.flags())[0].exceptAll(
        clinic.true_negatives_two_ways(star.flags())[1]).count() == 0


def test_one_death_source_per_person(star):
    several = star.deaths().groupBy("person_id").agg(F.count_distinct("death_source").alias("n"))
    assert several.where("n > 1").count() == 0


def test_grand_total_is_not_above_the_sum(star):
    rows = star.code_totals().where("population = 'Everyone'").collect()
    parts = sum(r.people for r in rows if not r.code_type.startswith("Grand"))
    total = sum(r.people for r in rows if r.code_type.startswith("Grand"))
    assert max(r.people for r in rows if not r.code_type.startswith("Grand")) <= total <= parts


# sources, stages, sinks


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_folder", lambda session: str(tmp_path))
    return stages.StageStore(spark, "run")


def case_ids(s):
    return {r.person_id for r in s.cases(ALIVE).collect()}


def test_staged_study_gives_the_same_cohort(spark, store, clinical):
    rows = frames(spark, **study_rows())
    staged = CohortStudy(rows, StudyConfig(), stages=store)
    want = case_ids(clinical)
    assert want and case_ids(staged) == want
    assert staged.stages.has("people") and staged.stages.has("features")
    assert not staged.stages.has("nothing") and not store.has("people")
    # the same study again finds its stages
    again = CohortStudy(rows, StudyConfig(), stages=store)
    assert again.stages.root == staged.stages.root and case_ids(again) == want


def test_another_study_has_stages_of_its_own(spark, store, clinical):
    rows = frames(spark, **study_rows())
    assert case_ids(CohortStudy(rows, StudyConfig(), stages=store)) == case_ids(clinical)
    never = StudyConfig(min_events=10 ** 6, min_gap_days=10 ** 6)
    assert case_ids(CohortStudy(rows, never, stages=store)) == set()
    fewer = {**rows, "gp_event": rows["gp_event"].where("false")}
    roots = {CohortStudy(t, c, stages=store, death_patterns=p).stages.root for t, c, p in (
        (rows, StudyConfig(), ("a",)), (rows, StudyConfig(), ("b",)), (rows, never, ("a",)),
        (fewer, StudyConfig(), ("a",)))}
    assert len(roots) == 4


def test_stage_is_reused_until_refreshed(spark, store):
    assert store.run("a", lambda: spark.range(3)).count() == 3
    assert store.run("a", lambda: spark.range(5)).count() == 3
    assert store.run("a", lambda: spark.range(5), refresh=True).count() == 5


def test_stage_folder_comes_from_the_session(spark, monkeypatch):
    assert stages.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", None)
    monkeypatch.setattr(stages, "shared_folder", lambda session: None)
    with pytest.raises(ValueError):
        stages.StageStore(spark, "run")


def test_bucketed_table_joins_without_shuffling_it(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        people = spark.range(1000).selectExpr("id AS person_id", "id % 5 AS v")
        a = stages.create_table(people, "bucketed_a", buckets=4)
        b = stages.create_table(people, "bucketed_b", buckets=4)
        plan = a.join(b, "person_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert a.join(b, "person_id").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        stages.drop_table(spark, "bucketed_a")
        stages.drop_table(spark, "bucketed_b")
    assert not spark.catalog.tableExists("bucketed_a")


def test_guard_and_report(spark, tmp_path):
    small = spark.range(10)
    assert sinks.guarded(small, 10).count() == 10
    with pytest.raises(sinks.RowBudgetExceeded):
        sinks.guarded(small, 9)
    assert sinks.within_budget(small, 9).first().asDict() == \
        {"event_count": 10, "within_budget": 0}
    path = str(tmp_path / "report")
    sinks.write_report(small, path)
    assert spark.read.csv(path, header=True).count() == 10
    with pytest.raises(sinks.RowBudgetExceeded):
        sinks.write_report(small, path, max_rows=9)
    # a report has no budget of its own
    many = spark.range(sinks.ROW_BUDGET + 1)
    sinks.write_report(many, path)
    assert spark.read.csv(path, header=True).count() == sinks.ROW_BUDGET + 1


def test_lookup_csv(spark, tmp_path):
    file = tmp_path / "boards.csv"
    file.write_text("district_code,board\nD1,North\nD2,South\n")
    got = tables.read_lookup_csv(spark, str(file), tables.SCHEMAS["board_lookup"])
    assert {tuple(r) for r in got.collect()} == {("D1", "North"), ("D2", "South")}


def test_snapshot_names(spark, tmp_path):
    cfg = StudyConfig(namespace=f"{tmp_path}/", snapshots={"death_register": "20210328"})
    spark.createDataFrame([(1, d("2001-01-01"))], tables.schema_of("death_register")) \
        .write.parquet(f"{tmp_path}/death_register_20210328")
    assert tables.open_tables(spark, ["death_register"], cfg)["death_register"].count() == 1
    assert cfg.table("death_register", "20220101").endswith("death_register_20220101")
    assert StudyConfig(namespace="study.").table("gp_event") == "study.gp_event"


def test_conform_trims_and_casts(spark):
    raw = spark.createDataFrame([("7", "2001-02-03 04:05:06", "G35 ")],
                                "person_id string, event_date string, code string")
    row = tables.conform(raw, "gp_event").first()
    assert (row.person_id, row.event_date, row.code, row.value) == (7, d("2001-02-03"), "G35", None)


@pytest.mark.parametrize("bad", ["NA", "", "2000-13-40", "X"])
def test_conform_nulls_bad_text(spark, bad):
    raw = spark.createDataFrame([(bad, bad, bad)],
                                "user_id string, completed string, group_id string")
    row = tables.conform(raw, "questionnaire").first()
    assert (row.user_id, row.completed, row.group_id) == (None, None, None)
    person = spark.createDataFrame([("5", bad, bad)],
                                   "person_id string, birth_date string, gender_cd string")
    row = tables.conform(person, "person_source").first()
    assert (row.person_id, row.birth_date, row.gender_cd) == (5, None, None)


def test_person_joins_share_one_partitioning(spark):
    """Without broadcasts, features join the base with no shuffle of their own."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        s = study(spark, SMALL)
        features = s.features()._jdf.queryExecution().executedPlan().toString()
        base = s.base()._jdf.queryExecution().executedPlan().toString()
        both = s.event_frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)

    def shuffles(plan):
        return plan.count("Exchange hashpartitioning(person_id#")

    assert shuffles(both) <= shuffles(features) + shuffles(base)
    # the events meet persons and deaths, are ranked and aggregated on one shuffle each
    assert shuffles(features) <= 4
