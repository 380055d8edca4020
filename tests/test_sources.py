"""Stored stages, snapshots and lookup files."""

import re

import pytest

from cohortspark.config import StudyConfig
from cohortspark.operators.events import outpatient_events
from cohortspark.plans.pipeline import ALIVE, CohortStudy
from cohortspark.plans.queries import QUERIES, study
from cohortspark.sources import snapshots, stages, tables
from tests.clinical import d, frames, study_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def staged_study(spark, tmp_path, **options):
    store = stages.StageStore(spark, "run", folder=str(tmp_path), **options)
    s = study(spark, SMALL)
    return CohortStudy(s.tables, s.cfg, s.codeset, s.death_patterns, stages=store)


def test_stages_meet_without_a_shuffle(spark, tmp_path, plain_joins):
    s = staged_study(spark, tmp_path, buckets=3)
    both = s.event_frame()  # the stages of people and of their features
    assert "Exchange" not in plan(both) and "SortMergeJoin" in plan(both)
    assert not re.search(r"\bSort \[", plan(both))  # each bucket is one sorted file
    counted = s.people().groupBy("person_id").count()
    assert "Exchange" not in plan(counted)
    want = study(spark, SMALL).event_frame()
    assert sorted(map(str, both.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_stages_of_an_earlier_session_keep_their_buckets(spark, tmp_path, plain_joins):
    s = staged_study(spark, tmp_path, buckets=3)
    rows = s.event_frame().count()
    for name in ("base", "features", "persons", "deaths", "tagged", "people"):
        stages.drop_table(spark, s.stages.table(name))
    again = staged_study(spark, tmp_path, buckets=3)
    assert again.stages.root == s.stages.root and again.stages.has("base")
    assert "Exchange" not in plan(again.event_frame())
    assert again.event_frame().count() == rows


def test_another_layout_is_another_stage(spark, tmp_path):
    roots = {staged_study(spark, tmp_path, buckets=n).stages.root for n in (2, 3)}
    assert len(roots) == 2
    store = stages.StageStore(spark, "run", folder=str(tmp_path), buckets=2)
    people = spark.createDataFrame([(1, "a"), (None, "b")], "person_id long, v string")
    assert sorted(map(str, store.run("p", lambda: people).collect())) == sorted(
        map(str, people.collect()))
    assert store.run("p", lambda: people.limit(0)).count() == 2
    assert store.run("p", lambda: people.limit(0), refresh=True).count() == 0


def write_inputs(spark, folder, stamp):
    for name, df in frames(spark, **study_rows()).items():
        df.write.parquet(f"{folder}/{name}_{stamp}")


def test_study_from_snapshots_and_a_lookup_file(spark, tmp_path):
    """The whole study over resolved names, its board lookup from a CSV file."""
    write_inputs(spark, tmp_path, "20210301")
    late = frames(spark)["gp_event"]
    late.write.parquet(f"{tmp_path}/gp_event_20220101")
    (tmp_path / "boards.csv").write_text("district_code,board\nD1,North\nD2,South\n")
    cfg = StudyConfig(namespace=f"{tmp_path}/", as_of="20210601", area_name="North",
                      lookup_files={"board_lookup": str(tmp_path / "boards.csv")})
    s = CohortStudy(tables.open_tables(spark, list(tables.SCHEMAS), cfg), cfg)
    assert {r.person_id for r in s.cases(ALIVE).collect()} == {1, 2}
    assert {r.board for r in s.located_alive().collect()} == {"North"}
    # a day later than the empty extract, nobody has events
    from dataclasses import replace
    later = replace(cfg, as_of="20220101")
    s = CohortStudy(tables.open_tables(spark, list(tables.SCHEMAS), later), later)
    assert s.cases(ALIVE).count() == 0


def test_snapshot_resolution(spark, tmp_path):
    for name in ("gp_event_20200101", "gp_event_20210101", "gp_event_extra_20200601", "gp_event_new",
                 "gp_event"):
        (tmp_path / name).mkdir()
    at = lambda day: StudyConfig(namespace=f"{tmp_path}/", as_of=day)
    assert snapshots.latest_stamp(spark, at("20201231"), "gp_event") == "20200101"
    assert snapshots.latest_stamp(spark, at("20210101"), "gp_event") == "20210101"
    assert snapshots.latest_stamp(spark, at("20210101"), "outpatient") is None
    with pytest.raises(snapshots.NoSnapshot, match="20200101"):
        snapshots.latest_stamp(spark, at("20191231"), "gp_event")


def test_snapshots_in_the_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS extracts")
    try:
        for stamp, day in (("20200101", "2001-01-01"), ("20210101", "2002-02-02")):
            rows = frames(spark, death_register=[(1, d(day))])["death_register"]
            stages.create_table(rows, f"extracts.death_register_{stamp}")
        cfg = StudyConfig(namespace="extracts.", as_of="20201231")
        assert tables.open_table(spark, "death_register", cfg).first().death_date == d("2001-01-01")
        named = StudyConfig(namespace="extracts.", as_of="20201231",
                            snapshots={"death_register": "20210101"})
        assert tables.open_table(spark, "death_register", named).first().death_date == d("2002-02-02")
    finally:
        spark.sql("DROP DATABASE extracts CASCADE")


@pytest.mark.parametrize("text, problem", [
    ("district_code,board\nD1,North\nD2\n", "bad line: D2"),
    ("district_code,board\nD1,North\nD2,South,x\n", "bad line: D2,South,x"),
    ("district_code,board\nD1,North\nD1,South\n", "repeated key: D1"),
    ("district_code,board\n,North\n", "no key"),
])
def test_bad_lookup_is_reported(spark, tmp_path, text, problem):
    (tmp_path / "boards.csv").write_text(text)
    with pytest.raises(tables.BadLookup, match=problem):
        tables.read_lookup_csv(spark, str(tmp_path / "boards.csv"), tables.SCHEMAS["board_lookup"],
                               "district_code")


def test_lookup_with_another_header_or_type(spark, tmp_path):
    path = str(tmp_path / "areas.csv")
    (tmp_path / "areas.csv").write_text("area_code,district_code,is_latest\nW1,D1,yes\n")
    with pytest.raises(tables.BadLookup, match="W1,D1,yes"):
        tables.read_lookup_csv(spark, path, tables.SCHEMAS["area_lookup"])
    (tmp_path / "areas.csv").write_text("district_code,area_code,is_latest\nD1,W1,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_lookup_csv(spark, path, tables.SCHEMAS["area_lookup"])
    (tmp_path / "areas.csv").write_text("area_code,district_code,is_latest\nW1,D1,1\nW1,D0,0\n")
    assert tables.read_lookup_csv(spark, path, tables.SCHEMAS["area_lookup"]).count() == 2


def test_visits_are_filtered_before_their_shuffle(spark, tmp_path, plain_joins):
    """A Bloom filter of the wanted diagnoses stands at the scan of the visits."""
    s = study(spark, SMALL)
    for name in ("outpatient", "outpatient_diagnosis"):
        s.tables[name].write.parquet(f"{tmp_path}/{name}")
    visits, diagnoses = (spark.read.parquet(f"{tmp_path}/{n}")
                         for n in ("outpatient", "outpatient_diagnosis"))
    small = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    spark.conf.set(small, "0")
    try:
        found = outpatient_events(visits, diagnoses, s.codeset, s.cfg)
        text = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(small)
    tested = [line for line in text.splitlines() if "might_contain" in line]
    assert len(tested) == 1 and "isnotnull(person_id" in tested[0]  # at the visits, not the codes
    assert re.search(r"bloom_filter_agg\(xxhash64\(_visit", text)
    want = outpatient_events(s.tables["outpatient"], s.tables["outpatient_diagnosis"], s.codeset,
                             s.cfg)
    assert sorted(map(tuple, found.distinct().collect()), key=str) == sorted(
        map(tuple, want.distinct().collect()), key=str)


def test_region_and_rule_change_the_result(spark):
    """Neighbouring queries differ, so their SQL would notice a rule that is ignored."""
    folder = "/root/testdata/sf0.01"
    regions = {QUERIES[n](spark, folder).count() for n in (
        "register_profile", "register_profile_narrow_region", "register_profile_unfiltered")}
    assert len(regions) == 3
    found = {QUERIES[n](spark, folder).where("sub_group LIKE '%Positive'").count()
             for n in ("match_miss", "match_miss_stricter")}
    assert len(found) == 2
    assert 0 < QUERIES["snapshot_events"](spark, folder).count() < \
        QUERIES["scan_coded_events"](spark, folder).count()
