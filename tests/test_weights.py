"""Rows that stand for several records give the results of the records themselves."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.rows import compare_frames, frame_difference, frames_equal, records
from cohortspark.operators import clinic, describe, events, timeline
from cohortspark.plans.pipeline import CohortStudy
from cohortspark.plans.queries import study
from tests.clinical import d, frames, study_rows

EVENTS = "person_id long, event_date date, source string, concept string, code string"
DEATHS = "person_id long, death_date date, copies long"
START = date(2000, 1, 1)


def people(spark, *ids):
    return spark.createDataFrame([(i, d("1950-01-01"), 1) for i in ids],
                                 "person_id long, birth_date date, gender_cd int")


def random_case(spark, seed):
    rng = random.Random(seed)
    day = lambda: START + timedelta(days=rng.randint(0, 40))
    ids = list(range(1, 30))
    coded = {(p, day(), rng.choice(["GP", "HOSPITAL"]), rng.choice(["core", "nmo"]), None)
             for p in ids for _ in range(rng.randint(0, 12))}
    died = {(p, rng.choice([None, day(), day()])): rng.randint(1, 4)
            for p in ids[:22] for _ in range(rng.randint(0, 6))}
    return (sorted(coded, key=str), [(*k, n) for k, n in died.items()], people(spark, *ids))


def survivors(coded, died):
    """Each event with the (death date, copies) that are not before it; one without deaths."""
    for event in coded:
        own = [(day, n) for p, day, n in died if p == event[0]] or [(None, 1)]
        yield event, [(day, n) for day, n in own if day is None or day >= event[1]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_weights_equal_the_repeated_rows(spark, seed):
    coded, died, persons = random_case(spark, seed)
    rows, deaths = spark.createDataFrame(coded, EVENTS), spark.createDataFrame(died, DEATHS)
    weighted = events.weighted_events(rows, persons, deaths)
    repeated = events.valid_events(rows, persons, deaths)
    got = {tuple(r[:4]): tuple(r[4:]) for r in weighted.select(
        "person_id", "event_date", "source", "concept", "dates", "copies").collect()}
    assert got == {e[:4]: (len(left), sum(n for _, n in left))
                   for e, left in survivors(coded, died) if left}
    got = sorted(map(str, map(tuple, repeated.select(
        "person_id", "event_date", "source", "concept", "death_date", "copies").collect())))
    assert got == sorted(str((*e[:4], *x)) for e, left in survivors(coded, died) for x in left)
    for n in (1, 3, 7):
        nth = [sorted(map(tuple, timeline.nth_event(x, n).collect())) for x in (weighted, repeated)]
        assert nth[0] == nth[1]
    features = [sorted(map(str, timeline.person_features(x).collect()))
                for x in (weighted, repeated)]
    assert features[0] == features[1] and len(features[0]) > 20


def test_many_events_meet_many_deaths(spark):
    """10,000 events and 10,000 deaths of one person stay 10,000 rows."""
    days = spark.range(10_000).selectExpr("date_add(DATE'1960-01-01', CAST(id AS INT)) AS day",
                                          "id DIV 10000 + 1 AS person_id")
    coded = days.selectExpr("person_id", "day AS event_date", "'GP' AS source",
                            "'core' AS concept", "CAST(NULL AS STRING) AS code")
    died = days.selectExpr("person_id", "day AS death_date", "2L AS copies")
    weighted = events.weighted_events(coded, people(spark, 1), died)
    plan = weighted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # events meet persons; deaths are merged in, not joined
    total = weighted.agg(F.count(F.lit(1)), F.sum("dates"), F.sum("copies")).first()
    # the k-th last event is followed by k deaths, its own day's included
    pairs = 10_000 * 10_001 // 2
    assert tuple(total) == (10_000, pairs, 2 * pairs)
    first = timeline.person_features(weighted).first()
    assert first.core_gp_count == 2 * pairs and first.core_event_7_date == d("1960-01-01")
    # 10,000 death dates follow the first event, so event 10,001 is on the second day
    assert timeline.nth_event(weighted, 10_001).first().nth_date == d("1960-01-02")


PEOPLE = ("person_id long, grp string, gender string, c string, age double, n long, flag boolean,"
          " copies long")


def weighted_people(spark, seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice(["Female", "Male", None]),
             rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(0, 90), 2)]),
             rng.randint(0, 5), rng.choice([True, False, None]), rng.randint(1, 4))
            for i in range(200)]
    rows += [(500, "one", "Male", "a", 7.5, 1, True, 1), (501, "none", None, None, None, 2, True, 2)]
    return spark.createDataFrame(rows, PEOPLE)


def text(df):
    return sorted(str(r) for r in df.collect())


def test_descriptions_count_each_record(spark):
    people_ = weighted_people(spark)
    single = records(people_)
    assert single.count() > people_.count() and "copies" not in single.columns
    for call in (lambda x: describe.describe(x, "grp", ["age", "n"], ["gender", "c"], "a"),
                 lambda x: describe.group_tests(x, "grp", ["age", "n"], ["gender", "c"]),
                 lambda x: clinic.summarise(x, "gender", ["n", "age"]),
                 lambda x: clinic.summarise(x.where("age IS NOT NULL"), "gender", ["n", "age"])):
        assert text(call(people_)) == text(call(single))


def test_descriptions_against_built_in_aggregates(spark):
    single = records(weighted_people(spark))
    got = {(r.group, r.variable, r.level): r for r in describe.describe(
        single, "grp", ["age"], ["gender"]).collect()}
    for r in single.groupBy("grp").agg(
            F.count("age").alias("n"), F.round(F.avg("age"), 4).alias("mean"),
            F.round(F.stddev_samp("age"), 4).alias("sd")).where("n > 0").collect():
        x = got[r.grp, "age", None]
        assert (x.n, x["mean"], x.sd, x.pct) == (r.n, r["mean"], r.sd, None)
    for r in single.where("gender IS NOT NULL").groupBy("grp", "gender").count().collect():
        assert got[r.grp, "gender", r.gender].n == r["count"]


def test_overlapping_groups_equal_repeated_people(spark):
    people_ = weighted_people(spark)
    groups = [describe.Group("all", F.lit(True), {"v": None}),
              describe.Group("flagged", F.col("flag"), {"v": F.col("age")}),
              describe.Group("women", F.col("gender") == "Female", {"v": F.col("age") + 1})]
    got = describe.described(describe.overlapping_stats(people_, groups, ["v", "n"], ["c"]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lowest = max(i for i, line in enumerate(plan.splitlines()) if "Generate" in line)
    assert any("Aggregate" in line for line in plan.splitlines()[lowest:])  # cells, not people
    stacked = None
    for g in groups:
        v = g.numbers["v"]
        rows = people_.where(g.condition).select(
            F.lit(g.label).alias("grp"), (F.lit(None) if v is None else v).cast("double").alias("v"),
            "n", "c", "copies")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    assert text(got) == text(describe.describe(stacked, "grp", ["v", "n"], ["c"]))


def test_person_frame_keeps_copies_to_the_output(spark):
    rows = study_rows()
    rows["death_register"] = [(5, d("2010-01-01"))] * 3 + [(5, d("2012-01-01")), (3, None)]
    s = CohortStudy(frames(spark, **rows), StudyConfig(area_name="North", site_units=("A1",)))
    base = s.base().where("person_id = 5").orderBy("death_date").collect()
    assert [(r.death_date, r.copies) for r in base] == [(d("2010-01-01"), 3), (d("2012-01-01"), 1)]
    frame = s.frame().where("person_id = 5").orderBy("death_date").collect()
    assert [r.death_date.year for r in frame] == [2010] * 3 + [2012] and "copies" not in frame[0]
    # 2003 precedes all four deaths, 2011 the last one
    assert frame[0].core_gp_count == 5
    dead = s.table_one("all").where("variable = 'dead' AND level = 'Dead' AND group = 'All Population'")
    assert dead.first().n == 4


def leaves(df):
    """Kinds of what a plan reads; what stands in memory counts as one."""
    found = df._jdf.queryExecution().withCachedData().collectLeaves()
    return [found.apply(i).nodeName().split()[0] for i in range(found.size())]


def test_equal_frames_are_compared_by_fingerprints(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(50_000).selectExpr("id % 9000 AS k", "CAST(id % 7 AS STRING) AS v") \
        .write.parquet(path)
    df = spark.read.parquet(path)
    same = compare_frames(df, df.orderBy("v"))
    assert same.first().asDict() == {"left_rows": 50_000, "right_rows": 50_000, "differing_rows": 0}
    assert leaves(same) == ["InMemoryRelation"]  # nothing is read again
    other = df.where("k <> 5").unionByName(spark.range(1).selectExpr("77L AS k", "'7' AS v"))
    want = df.where("k = 5").distinct().count() + 1
    assert compare_frames(df, other).first().differing_rows == want
    assert frame_difference(df, other).count() == want
    empty = df.where("false")
    assert compare_frames(empty, empty).first().asDict() == {
        "left_rows": 0, "right_rows": 0, "differing_rows": 0}
    assert compare_frames(df, empty).first().differing_rows == df.distinct().count()


def test_fingerprints_see_single_changes(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 5), rng.choice("abc")) for _ in range(40)]
    frame = lambda x: spark.createDataFrame(x, "k int, v string")
    for i in range(5):
        changed = [*rows[:i], (rows[i][0] + 1, rows[i][1]), *rows[i + 1:]]
        assert not frames_equal(frame(rows), frame(changed))
        assert not frames_equal(frame(rows), frame([*rows, rows[i]]))
    rng.shuffle(changed := list(rows))
    assert frames_equal(frame(rows), frame(changed))


@pytest.mark.parametrize("name", ["disagreement", "attrition"])
def test_clinic_results_read_the_flags_once(spark, name):
    s = study(spark, "/root/testdata/sf0.001")
    s._built["flags"] = s.flags().where("length('read once') = 9")
    plan = getattr(s, name)()._jdf.queryExecution().analyzed().toString()
    assert plan.count("read once") == 1


def test_true_negatives_read_the_flags_once(spark):
    s = study(spark, "/root/testdata/sf0.001")
    same = clinic.compare_true_negatives(s.flags())
    assert same.first().differing_rows == 0
    assert leaves(same) == ["InMemoryRelation"]
