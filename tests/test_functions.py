from datetime import date, timedelta

from pyspark.sql import functions as F

from cohortspark.functions import dates, labels, rows


def column(spark, values, ddl, build):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ddl)
    return [r[0] for r in df.select(build).collect()]


def test_years_between_over_a_century(spark):
    start = date(1900, 1, 1)
    days = list(range(-400, 36525, 331))
    df = spark.createDataFrame([(start + timedelta(n), start) for n in days], "a date, b date")
    got = [r[0] for r in df.select(dates.years_between(F.col("a"), F.col("b"))).collect()]
    # no number of days falls on a tie at two decimals, so any rounding mode agrees
    assert got == [round(n / 365.25, 2) + 0.0 for n in days]


def test_whole_number_takes_digits_only(spark):
    got = column(spark, ["1999", "NA", "X", "", " 5", "12a", None, "99999999999"], "v string",
                 dates.whole_number(F.col("v")))
    assert got == [1999, None, None, None, None, None, None, None]


def test_partial_date(spark):
    cases = [(2000, 0), (2000, 1), (2000, 12), (2000, 13), (2000, None), (0, 5), (2021, 5),
             (None, 5)]
    strict = column(spark, cases, "y int, m int",
                    dates.partial_date(F.col("y"), F.col("m"), 2020))
    assert strict == [date(2000, 1, 1), date(2000, 1, 1), date(2000, 12, 1)] + [None] * 5
    lenient = column(spark, cases, "y int, m int", dates.partial_date(
        F.col("y"), F.col("m"), 2020, missing_month_is_january=True))
    assert lenient[4] == date(2000, 1, 1) and lenient[3] is None and lenient[5:] == [None] * 3


def test_age_bracket_edges(spark):
    ages = [-1.0, 9.99, 10.0, 14.99, 15.0, 84.99, 85.0, 101.5, None]
    assert column(spark, ages, "v double", labels.age_bracket(F.col("v"))) == [
        "Under 10", "Under 10", "10 - 14", "10 - 14", "15 - 19", "80 - 84", "Over 85", "Over 85",
        "Error"]


def test_first_answer_skips_marks_and_nulls(spark):
    cases = [("NA", None, "2"), ("3", "1", "NA"), ("NA", "NA", None)]
    got = column(spark, cases, "a string, b string, c string",
                 labels.first_answer([F.col("a"), F.col("b"), F.col("c")]))
    assert got == ["2", "3", None]


def test_many_values_counts_null_as_a_value(spark):
    df = spark.createDataFrame(
        [(1, 5), (1, 5), (2, 5), (2, None), (3, None), (3, None), (4, 1), (4, 2)], "k int, v int")
    got = dict(df.groupBy("k").agg(rows.many_values("v")).collect())
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_single_row_ids(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "a", None), (2, "a", 1), (2, "a", None), (None, "x", 3)],
        "k int, v string, w int")
    assert sorted(map(str, map(tuple, rows.single_row_ids(df, "k").collect()))) == \
        ["(1, 'a', None)", "(None, 'x', 3)"]


def test_sets_keep_null_keys_on_the_left(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ids = spark.createDataFrame([(1,)], "k int")
    nulls = spark.createDataFrame([(1,), (None,)], "k int")

    def keys(out):
        return {r[0] for r in out.collect()}

    assert keys(rows.in_set(df, ids, "k")) == {1}
    assert keys(rows.not_in_set(df, ids, "k")) == {2, None}
    assert keys(rows.not_in_set(df, nulls, "k")) == {2}


def test_top_row_is_total_and_puts_nulls_last(spark):
    df = spark.createDataFrame(
        [(1, None, "z"), (1, 5, "b"), (1, 5, "a"), (2, None, "q")], "k int, v int, t string")
    got = rows.top_row(df, ["k"], [F.col("v").desc_nulls_last()]).collect()
    assert {tuple(r) for r in got} == {(1, 5, "a"), (2, None, "q")}


def test_top_row_limits_groups_before_the_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = rows.top_row(df, ["k"], [F.col("v").desc()])._jdf.queryExecution() \
        .executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[:shuffle] and "WindowGroupLimit" in plan[shuffle:]


def test_repeat_rows_crosses_chunks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 10)], "k string, n long")
    out = rows.repeat_rows(df, "n", chunk=5)
    assert out.columns == ["k"]
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == \
        {"a": 1, "b": 7, "c": 10}


def test_frames_equal_counts_duplicates(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    assert rows.frames_equal(a, a.select("v", "k"))
    assert not rows.frames_equal(a, b)
    assert not rows.frames_equal(a, a.drop("v"))
    assert rows.compare_frames(a, b).first().asDict() == \
        {"left_rows": 3, "right_rows": 3, "differing_rows": 2}
