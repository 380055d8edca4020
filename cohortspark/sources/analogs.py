"""Linked-record inputs derived from a star schema of orders.

The star schema has no health records, so each input of the study is a view on
whole business tables: customers are people, orders are primary-care events and
hospital stays, line items are diagnoses, visits and addresses, and user events
are questionnaire answers.  Values are derived from attributes; no view takes a
sample of its table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.codes import (
    CORE,
    EXTRA,
    FAMILY_HISTORY,
    GP,
    INPATIENT,
    NMO,
    OUTPATIENT,
    CodeSet,
    hospital,
    rules,
)
from cohortspark.config import StudyConfig

STUDY = StudyConfig(
    year_min=1996, year_max=2000, birth_year_ceiling=1999, region_prefix="A",
    area_name="ASIA", site_units=("U1", "U3"), recent_site_year=1998,
)
CODES = CodeSet((
    *rules(CORE, GP, ["1PA..", "1PB..", "1OC.."]),
    *rules(CORE, INPATIENT, ["E07", "M11", "L22", "P05"], prefix=True),
    *rules(CORE, OUTPATIENT, ["E07", "M11", "L22", "P05"], field="stem"),
    *rules(EXTRA, GP, ["2FA..", "2FB..", "3OC..", "4PD..", "1OE.."]),
    *hospital(EXTRA, ["S30"], field="stem"),
    *hospital(EXTRA, ["L103", "P109", "P108", "L108"]),
    *rules("optic_neuritis", GP, ["2FA.."]),
    *hospital("optic_neuritis", ["S30X"]),
    *rules("transverse_myelitis", GP, ["2FB.."]),
    *hospital("transverse_myelitis", ["L103"]),
    *rules("encephalitis", GP, ["3OC.."]),
    *hospital("encephalitis", ["P109"]),
    *rules("cns_demyelination", GP, ["4PD.."]),
    *hospital("cns_demyelination", ["P108"]),
    *rules("acute_demyelination", GP, ["1OE.."]),
    *hospital("acute_demyelination", ["L108"]),
    *rules(NMO, GP, ["5PG.."]),
    *hospital(NMO, ["M220", "M224"]),
    *rules(FAMILY_HISTORY, GP, ["3FH.."]),
))
DEATH_PATTERNS = (r"^5O[A].{2}$", r"^5P[J].{2}$")


BIRTH = "date_add(DATE'1900-01-01', CAST({key} * 7919 % 36500 AS INT))"
CUSTOMER_BIRTH, ORDER_BIRTH = BIRTH.format(key="c_custkey"), BIRTH.format(key="o_custkey")
LINK = ("CAST(CASE WHEN {untrusted} THEN 99 WHEN c_nationkey % 3 = 0 THEN 1 "
        "WHEN c_nationkey % 3 = 1 THEN 4 ELSE 39 END AS INT)")
AREA = "concat(IF({nation} < 22, 'A', 'Z'), lpad(CAST({nation} AS STRING), 2, '0'))"
UNIT = "concat('U', CAST({key} % 7 AS STRING))"


def _variants(df: DataFrame, base: dict[str, str],
              *others: tuple[str, dict[str, str]]) -> DataFrame:
    """The base row of each record, and further rows where a condition holds, in one scan.

    Each variant names only the columns in which it differs from the base.
    """
    def cell(columns: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in columns.items()) + ")"

    cells = [cell(base)] + [f"CASE WHEN {c} THEN {cell(base | diff)} END" for c, diff in others]
    return df.selectExpr(f"explode(array({', '.join(cells)})) AS v") \
        .where("v IS NOT NULL").select("v.*")


# Columns the views use; a declared schema spares the inference job per table.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
}


class StarTables(Mapping[str, DataFrame]):
    """Tables of the star schema and the study inputs on them, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def star(self, name: str) -> DataFrame:
        return self._once(f"star/{name}", lambda: self._spark.read.schema(
            STAR_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet"))

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def __getitem__(self, name: str) -> DataFrame:
        view, sources = VIEWS[name]
        return self._once(name, lambda: view(*(self.star(s) for s in sources)))

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)


def person_source(customer: DataFrame) -> DataFrame:
    base = {
        "person_id": "c_custkey", "birth_date": CUSTOMER_BIRTH,
        "gender_cd": "CAST(CASE WHEN c_acctbal < -900 THEN 9 WHEN c_acctbal < -800 THEN 3 "
                     "ELSE 1 + c_custkey % 2 END AS INT)",
        "link_status": LINK.format(untrusted="c_nationkey = 24"),
    }
    return _variants(
        customer, base,
        ("c_acctbal >= 9000 AND c_acctbal < 9100",
         {"birth_date": f"date_add({CUSTOMER_BIRTH}, 7)", "link_status": "1"}),
        ("c_acctbal >= 8000 AND c_acctbal < 8100",
         {"gender_cd": "CAST(2 - c_custkey % 2 AS INT)", "link_status": "1"}),
        ("c_acctbal >= 7000 AND c_acctbal < 7100",
         {"birth_date": "CAST(NULL AS DATE)", "link_status": "1"}),
        ("c_acctbal >= 6000 AND c_acctbal < 6050", {"person_id": "CAST(NULL AS BIGINT)"}),
        ("c_acctbal >= 5000 AND c_acctbal < 5100", {}),
    )


def gp_event(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "IF(o_totalprice >= 3000, o_custkey, NULL) AS person_id",
        "CAST(o_orderdate AS DATE) AS event_date", "year(o_orderdate) AS event_year",
        "concat(substring(o_orderpriority, 1, 1), o_orderstatus, "
        "chr(65 + floor(o_totalprice / 50000)), '..') AS code",
        "o_totalprice AS value", "o_orderkey AS sequence", f"{ORDER_BIRTH} AS birth_date",
        "IF(o_totalprice > 495000, 99, 1) AS link_status",
    )


def inpatient_spell(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        f"{UNIT.format(key='o_orderkey')} AS unit", "o_orderkey AS spell_no",
        "o_custkey AS person_id", "date_add(CAST(o_orderdate AS DATE), 10) AS admission_date",
        "date_add(CAST(o_orderdate AS DATE), 15) AS discharge_date",
        "IF(o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_totalprice < 60000, 4, 1) "
        "AS discharge_method",
    )


def inpatient_episode(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(f"{UNIT.format(key='l_orderkey')} AS unit",
                               "l_orderkey AS spell_no", "l_linenumber AS episode_no")


def _diagnosed(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Line items with the diagnosis code of their part: stem and optional fourth character."""
    codes = part.selectExpr(
        "p_partkey", "CAST(substring(p_brand, 7) AS INT) AS brand",
        "concat(substring(p_type, 1, 1), lpad(CAST(p_size AS STRING), 2, '0')) AS stem",
    ).selectExpr("p_partkey", "stem", "IF(brand > 5, CAST(brand % 10 AS STRING), NULL) AS fourth")
    return lineitem.join(codes, F.col("l_partkey") == F.col("p_partkey"))


def inpatient_diagnosis(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return _diagnosed(lineitem, part).selectExpr(
        f"{UNIT.format(key='l_orderkey')} AS unit", "l_orderkey AS spell_no",
        "l_linenumber AS episode_no", "stem", "concat(stem, coalesce(fourth, 'X')) AS code")


VISIT_KEYS = (
    "concat('P', CAST(l_suppkey AS STRING)) AS unit",
    "CAST(l_shipdate AS DATE) AS available_date", "l_orderkey AS attendance_id",
    "CAST(l_linenumber AS BIGINT) AS case_no", "CAST(l_shipdate AS DATE) AS attended_date",
)


def outpatient(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")) \
        .selectExpr(*VISIT_KEYS, "o_custkey AS person_id")


def outpatient_diagnosis(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return _diagnosed(lineitem, part).selectExpr(*VISIT_KEYS, "stem", "fourth")


def death_register(customer: DataFrame) -> DataFrame:
    died = "date_add(DATE'1999-01-01', CAST(c_custkey * 31 % 900 AS INT))"
    return _variants(
        customer.where("c_acctbal >= -700 AND c_acctbal < -300"),
        {"person_id": "c_custkey", "death_date": died},
        ("c_acctbal >= -350", {"death_date": f"date_add({died}, 40)"}))


def demographics(customer: DataFrame) -> DataFrame:
    return customer.where("c_acctbal >= -400 AND c_acctbal < 0").selectExpr(
        "c_custkey AS person_id",
        "CASE WHEN c_acctbal < -20 THEN date_add(DATE'1998-06-01', "
        "CAST(c_custkey * 17 % 900 AS INT)) END AS death_date")


def dictionary_a(orders: DataFrame) -> DataFrame:
    return gp_event(orders).selectExpr("code", "substring(code, 1, 1) AS description").distinct()


def dictionary_b(orders: DataFrame) -> DataFrame:
    return gp_event(orders).selectExpr(
        "code", "IF(substring(code, 2, 1) <> 'O', substring(code, 1, 2), NULL) AS long_term",
        "substring(code, 2, 1) AS short_term").distinct()


def residence(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .selectExpr(
            "o_custkey AS person_id", "CAST(l_shipdate AS DATE) AS start_date",
            f"CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN DATE'{STUDY.open_end}' "
            "ELSE date_add(CAST(l_shipdate AS DATE), CAST(l_quantity * 20 AS INT)) END "
            "AS end_date",
            f"IF(l_quantity < 50, {AREA.format(nation='s_nationkey')}, NULL) AS area_code",
            "IF(s_nationkey < 20, 1, 0) AS in_region", "l_suppkey AS household_id")
    )


def area_lookup(nation: DataFrame) -> DataFrame:
    """The current district of each area and an outdated one."""
    return _variants(
        nation,
        {"area_code": AREA.format(nation="n_nationkey"),
         "district_code": "concat('D', CAST(n_regionkey AS STRING))", "is_latest": "1"},
        ("TRUE", {"district_code": "concat('D', CAST((n_regionkey + 1) % 5 AS STRING))",
                  "is_latest": "0"}))


def board_lookup(region: DataFrame) -> DataFrame:
    return region.selectExpr("concat('D', CAST(r_regionkey AS STRING)) AS district_code",
                             "r_name AS board")


def provider_unit(region: DataFrame) -> DataFrame:
    return region.selectExpr("concat('U', CAST(r_regionkey AS STRING)) AS unit",
                             "r_name AS unit_name")


def register_link(customer: DataFrame) -> DataFrame:
    base = {
        "user_id": "c_custkey", "person_id": "c_custkey",
        "link_status": LINK.format(untrusted="c_mktsegment = 'FURNITURE'"),
        "birth_date": "CASE WHEN c_acctbal >= 2000 AND c_acctbal < 2500 "
                      f"THEN date_add({CUSTOMER_BIRTH}, 3) "
                      "WHEN c_acctbal >= 2500 AND c_acctbal < 2600 THEN NULL "
                      f"ELSE {CUSTOMER_BIRTH} END",
        "gender_cd": "CAST(CASE WHEN c_acctbal >= 2600 AND c_acctbal < 2700 THEN 9 "
                     "ELSE 1 + c_custkey % 2 END AS INT)",
        "area_code": AREA.format(nation="c_nationkey"),
    }
    return _variants(customer, base, ("c_acctbal >= 3000 AND c_acctbal < 3300",
                                      {"gender_cd": "CAST(2 - c_custkey % 2 AS INT)"}))


def questionnaire(events: DataFrame) -> DataFrame:
    answered = events.selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS n")
    return answered.selectExpr(
        "user_id", "ts AS completed", "event_id AS group_id",
        "CASE event_type WHEN 'error' THEN 'NA' WHEN 'view' THEN 'X' "
        "ELSE CAST(1960 + n % 45 AS STRING) END AS onset_year",
        "IF(event_type = 'signup', 'NA', CAST(n % 15 AS STRING)) AS onset_month",
        "IF(event_type = 'view', 'X9', CAST(1990 + n % 20 AS STRING)) AS now_year",
        "CAST(n % 13 AS STRING) AS now_month",
        "CASE n % 10 WHEN 0 THEN '3' WHEN 9 THEN NULL ELSE 'NA' END AS now_unsure",
        "IF(n % 10 IN (1, 2), '0', 'NA') AS now_primary",
        "CASE WHEN n % 10 IN (3, 4, 5) THEN '1' WHEN n % 10 = 6 THEN '4' ELSE 'NA' END "
        "AS now_relapsing",
        "IF(n % 10 IN (7, 9), '2', 'NA') AS now_secondary",
        "IF(event_type = 'error', 'NA', CAST(1992 + n % 12 AS STRING)) AS diagnosis_year",
        "CASE event_type WHEN 'signup' THEN 'NA' WHEN 'view' THEN NULL "
        "ELSE CAST(n % 14 AS STRING) END AS diagnosis_month",
        "CASE n % 6 WHEN 4 THEN 'NA' WHEN 5 THEN '7' ELSE CAST(n % 6 AS STRING) END "
        "AS type_at_diagnosis",
    )


def raw_event(events: DataFrame) -> DataFrame:
    """User events as a text extract: padded codes, blanks, bad numbers and dates."""
    return events.selectExpr(
        "CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE CAST(user_id AS STRING) END "
        "AS person_id",
        "CASE event_id % 5 WHEN 0 THEN '2000-13-40' WHEN 1 THEN '' WHEN 2 THEN 'X' "
        "ELSE date_format(ts, 'yyyy-MM-dd') END AS event_date",
        "IF(event_id % 3 = 0, 'NA', CAST(year(ts) AS STRING)) AS event_year",
        "concat(event_type, '   ') AS code",
        "IF(event_id % 4 = 0, 'X', CAST(value AS STRING)) AS value",
        "CAST(event_id AS STRING) AS sequence")


def clinic_link(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS system_id", "IF(c_acctbal <= 9900, c_custkey, NULL) AS person_id",
        f"{CUSTOMER_BIRTH} AS birth_date", f"{AREA.format(nation='c_nationkey')} AS area_code",
        "CAST(1 + c_custkey % 2 AS INT) AS gender_cd")


def clinic_details(customer: DataFrame) -> DataFrame:
    when = ("CASE WHEN c_acctbal < 7900 OR c_acctbal >= 8000 THEN "
            "date_add(DATE'1994-06-01', CAST(c_custkey * 13 % 2400 AS INT)) END")
    return _variants(
        customer.where("c_acctbal >= 2000"),
        {"system_id": "c_custkey",
         "diagnosis": "IF(c_mktsegment IN ('MACHINERY', 'AUTOMOBILE'), 'MS', 'OTHER')",
         "diagnosis_date": when,
         "onset_date": f"date_sub({when}, CAST(c_custkey % 1000 AS INT))"},
        ("c_acctbal >= 8000 AND c_acctbal < 8500",
         {"diagnosis": "'MS'", "diagnosis_date": f"date_sub({when}, 30)"}))


# Each study input: its view and the star tables it reads.
VIEWS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "person_source": (person_source, ("customer",)),
    "gp_event": (gp_event, ("orders",)),
    "inpatient_spell": (inpatient_spell, ("orders",)),
    "inpatient_episode": (inpatient_episode, ("lineitem",)),
    "inpatient_diagnosis": (inpatient_diagnosis, ("lineitem", "part")),
    "outpatient": (outpatient, ("lineitem", "orders")),
    "outpatient_diagnosis": (outpatient_diagnosis, ("lineitem", "part")),
    "death_register": (death_register, ("customer",)),
    "demographics": (demographics, ("customer",)),
    "dictionary_a": (dictionary_a, ("orders",)),
    "dictionary_b": (dictionary_b, ("orders",)),
    "residence": (residence, ("lineitem", "orders", "supplier")),
    "residence_area": (residence, ("lineitem", "orders", "supplier")),
    "residence_household": (residence, ("lineitem", "orders", "supplier")),
    "area_lookup": (area_lookup, ("nation",)),
    "board_lookup": (board_lookup, ("region",)),
    "provider_unit": (provider_unit, ("region",)),
    "register_link": (register_link, ("customer",)),
    "questionnaire": (questionnaire, ("events",)),
    "raw_event": (raw_event, ("events",)),
    "clinic_link": (clinic_link, ("customer",)),
    "clinic_details": (clinic_details, ("customer",)),
}


def study_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """All inputs of a study from a folder of star-schema Parquet files."""
    return StarTables(spark, folder)
