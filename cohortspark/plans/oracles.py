"""Plain SQL for the registered queries, to be run by another engine on the same tables.

Each entry of ``VIEWS`` states one result in the most direct way, with
windows, ``NOT IN`` and joins, independently of how the Spark operators are
planned.  ``oracle_sql`` puts the views a query needs in front of it.
"""

from __future__ import annotations

import re

from cohortspark.plans import queries
from cohortspark.plans.pipeline import STAGE_AGE_GROUPS
from cohortspark.sources import analogs

CFG, CODES = analogs.STUDY, analogs.CODES
FROM, TO = f"DATE '{CFG.date_min}'", f"DATE '{CFG.date_max}'"
DIAG_FROM, DIAG_TO = f"DATE '{CFG.diagnosis_min}'", f"DATE '{CFG.diagnosis_max}'"
TRUSTED = "(1, 4, 39)"
SITES = ", ".join(f"'{u}'" for u in CFG.site_units)
DEATH_REGEX = "|".join(f"({p})" for p in analogs.DEATH_PATTERNS)
BIRTH = "DATE '1900-01-01' + CAST(c_custkey * 7919 % 36500 AS INTEGER)"
EVENT_COLUMNS = "person_id, event_date, event_year, code, value, sequence"


def years(later: str, earlier: str) -> str:
    return f"(round(({later} - {earlier}) / 365.25, 2) + 0.0)"


def link(untrusted: str) -> str:
    return (f"CAST(CASE WHEN {untrusted} THEN 99 WHEN c_nationkey % 3 = 0 THEN 1 "
            f"WHEN c_nationkey % 3 = 1 THEN 4 ELSE 39 END AS INTEGER)")


def area(nation: str) -> str:
    return (f"(CASE WHEN {nation} < 22 THEN 'A' ELSE 'Z' END "
            f"|| lpad(CAST({nation} AS VARCHAR), 2, '0'))")


def number(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '[0-9]+') THEN TRY_CAST({text} AS INTEGER) END"


def first_day(year: str, month: str, null_is_january: bool = False) -> str:
    extra = f" OR {month} IS NULL" if null_is_january else ""
    return (f"CASE WHEN {year} > 0 AND {year} <= {CFG.year_max} THEN "
            f"CASE WHEN {month} BETWEEN 1 AND 12 THEN make_date({year}, {month}, 1) "
            f"WHEN {month} = 0{extra} THEN make_date({year}, 1, 1) END END")


def codeset_rows() -> str:
    return ", ".join(
        f"('{r.concept}', '{r.system}', '{r.field}', {str(r.prefix).upper()}, '{r.value}', "
        f"{str(r.concept in CODES.by_code).upper()})" for r in CODES.rules)


def code_match(record: str, system: str) -> str:
    stem = f" OR (c.field = 'stem' AND {record}.stem = c.value)" if system != "GP" else ""
    return (f"c.system = '{system}' AND ((c.is_prefix AND starts_with({record}.code, c.value)) OR "
            f"(NOT c.is_prefix AND c.field = 'code' AND {record}.code = c.value){stem})")


def top(source: str, key: str, order: str, columns: str = "*") -> str:
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1")


def counts_of(concept: str, source: str) -> str:
    return (f"CAST(count(*) FILTER (WHERE concept = '{concept}' AND source = '{source}') "
            f"AS BIGINT) AS {concept}_{source.lower()}_count")


CONCEPTS = ("core", "optic_neuritis", "transverse_myelitis", "encephalitis", "cns_demyelination",
            "acute_demyelination", "nmo")
ALL_COUNTS = ", ".join(counts_of(c, s) for c in CONCEPTS for s in ("GP", "HOSPITAL"))
COUNT_NAMES = [f"{c}_{s}_count" for c in CONCEPTS for s in ("gp", "hospital")]

VIEWS: dict[str, str] = {}

# inputs

VIEWS["person_base"] = f"""
SELECT c_custkey AS person_id, {BIRTH} AS birth_date,
  CAST(CASE WHEN c_acctbal < -900 THEN 9 WHEN c_acctbal < -800 THEN 3
       ELSE 1 + c_custkey % 2 END AS INTEGER) AS gender_cd,
  {link('c_nationkey = 24')} AS link_status, c_acctbal, c_custkey FROM customer"""
VIEWS["person_source"] = """
SELECT person_id, birth_date, gender_cd, link_status FROM person_base
UNION ALL SELECT person_id, birth_date + 7, gender_cd, 1 FROM person_base
  WHERE c_acctbal >= 9000 AND c_acctbal < 9100
UNION ALL SELECT person_id, birth_date, CAST(2 - c_custkey % 2 AS INTEGER), 1 FROM person_base
  WHERE c_acctbal >= 8000 AND c_acctbal < 8100
UNION ALL SELECT person_id, NULL, gender_cd, 1 FROM person_base
  WHERE c_acctbal >= 7000 AND c_acctbal < 7100
UNION ALL SELECT NULL, birth_date, gender_cd, link_status FROM person_base
  WHERE c_acctbal >= 6000 AND c_acctbal < 6050
UNION ALL SELECT person_id, birth_date, gender_cd, link_status FROM person_base
  WHERE c_acctbal >= 5000 AND c_acctbal < 5100"""
VIEWS["gp_event"] = f"""
SELECT CASE WHEN o_totalprice >= 3000 THEN o_custkey END AS person_id,
  CAST(o_orderdate AS DATE) AS event_date, CAST(year(o_orderdate) AS INTEGER) AS event_year,
  substr(o_orderpriority, 1, 1) || o_orderstatus
    || chr(CAST(65 + floor(o_totalprice / 50000) AS INTEGER)) || '..' AS code,
  o_totalprice AS value, o_orderkey AS sequence,
  {BIRTH.replace('c_custkey', 'o_custkey')} AS birth_date,
  CASE WHEN o_totalprice > 495000 THEN 99 ELSE 1 END AS link_status FROM orders"""
VIEWS["spell"] = """
SELECT 'U' || CAST(o_orderkey % 7 AS VARCHAR) AS unit, o_orderkey AS spell_no,
  o_custkey AS person_id, CAST(o_orderdate AS DATE) + 10 AS admission_date,
  CAST(o_orderdate AS DATE) + 15 AS discharge_date,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AND o_totalprice < 60000
       THEN 4 ELSE 1 END AS discharge_method FROM orders"""
VIEWS["episode"] = """
SELECT DISTINCT 'U' || CAST(l_orderkey % 7 AS VARCHAR) AS unit, l_orderkey AS spell_no,
  l_linenumber AS episode_no FROM lineitem"""
VIEWS["diagnosed"] = """
SELECT *, substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS stem,
  CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) > 5
       THEN CAST(CAST(substr(p_brand, 7) AS INTEGER) % 10 AS VARCHAR) END AS fourth
FROM lineitem JOIN part ON l_partkey = p_partkey"""
VIEWS["inpatient_diag"] = """
SELECT 'U' || CAST(l_orderkey % 7 AS VARCHAR) AS unit, l_orderkey AS spell_no,
  l_linenumber AS episode_no, stem, stem || coalesce(fourth, 'X') AS code FROM diagnosed"""
VIEWS["visit"] = """
SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS unit, CAST(l_shipdate AS DATE) AS available_date,
  l_orderkey AS attendance_id, l_linenumber AS case_no,
  CAST(l_shipdate AS DATE) AS attended_date, o_custkey AS person_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
VIEWS["visit_diag"] = """
SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS unit, CAST(l_shipdate AS DATE) AS available_date,
  l_orderkey AS attendance_id, l_linenumber AS case_no,
  CAST(l_shipdate AS DATE) AS attended_date, stem,
  CASE WHEN fourth IS NULL THEN stem ELSE stem || fourth END AS code FROM diagnosed"""
VIEWS["death_register"] = """
SELECT c_custkey AS person_id, DATE '1999-01-01' + CAST(c_custkey * 31 % 900 AS INTEGER)
  AS death_date FROM customer WHERE c_acctbal >= -700 AND c_acctbal < -300
UNION ALL
SELECT c_custkey, DATE '1999-01-01' + CAST(c_custkey * 31 % 900 AS INTEGER) + 40
FROM customer WHERE c_acctbal >= -350 AND c_acctbal < -300"""
VIEWS["demographics"] = """
SELECT c_custkey AS person_id, CASE WHEN c_acctbal < -20
  THEN DATE '1998-06-01' + CAST(c_custkey * 17 % 900 AS INTEGER) END AS death_date
FROM customer WHERE c_acctbal >= -400 AND c_acctbal < 0"""
VIEWS["dictionary"] = """
SELECT code, substr(code, 1, 1) AS description FROM gp_event
UNION
SELECT code, CASE WHEN substr(code, 2, 1) = 'O' THEN substr(code, 2, 1)
             ELSE substr(code, 1, 2) END FROM gp_event"""
VIEWS["home"] = f"""
SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS start_date,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN DATE '9999-01-01'
       ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 20 AS INTEGER) END AS end_date,
  CASE WHEN l_quantity < 50 THEN {area('s_nationkey')} END AS area_code,
  CASE WHEN s_nationkey < 20 THEN 1 ELSE 0 END AS in_region, l_suppkey AS household_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"""
VIEWS["region_area"] = f"""
SELECT DISTINCT {area('n_nationkey')} AS area_code,
  'D' || CAST(n_regionkey AS VARCHAR) AS district_code FROM nation
WHERE starts_with({area('n_nationkey')}, '{CFG.region_prefix}')"""
VIEWS["board_of"] = """
SELECT 'D' || CAST(r_regionkey AS VARCHAR) AS district_code, r_name AS board FROM region"""
VIEWS["register_link"] = f"""
SELECT c_custkey AS user_id, c_custkey AS person_id, {link("c_mktsegment = 'FURNITURE'")}
  AS link_status,
  CASE WHEN c_acctbal >= 2000 AND c_acctbal < 2500 THEN {BIRTH} + 3
       WHEN c_acctbal >= 2500 AND c_acctbal < 2600 THEN NULL ELSE {BIRTH} END AS birth_date,
  CAST(CASE WHEN c_acctbal >= 2600 AND c_acctbal < 2700 THEN 9 ELSE 1 + c_custkey % 2 END
       AS INTEGER) AS gender_cd, {area('c_nationkey')} AS area_code FROM customer
UNION ALL
SELECT c_custkey, c_custkey, {link("c_mktsegment = 'FURNITURE'")}, {BIRTH},
  CAST(2 - c_custkey % 2 AS INTEGER), {area('c_nationkey')}
FROM customer WHERE c_acctbal >= 3000 AND c_acctbal < 3300"""
VIEWS["event_n"] = """
SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events"""
VIEWS["questionnaire"] = """
SELECT user_id, ts AS completed, event_id AS group_id,
  CASE event_type WHEN 'error' THEN 'NA' WHEN 'view' THEN 'X'
       ELSE CAST(1960 + n % 45 AS VARCHAR) END AS onset_year,
  CASE event_type WHEN 'signup' THEN 'NA' ELSE CAST(n % 15 AS VARCHAR) END AS onset_month,
  CASE event_type WHEN 'view' THEN 'X9' ELSE CAST(1990 + n % 20 AS VARCHAR) END AS now_year,
  CAST(n % 13 AS VARCHAR) AS now_month,
  CASE n % 10 WHEN 0 THEN '3' WHEN 9 THEN NULL ELSE 'NA' END AS now_unsure,
  CASE WHEN n % 10 IN (1, 2) THEN '0' ELSE 'NA' END AS now_primary,
  CASE WHEN n % 10 IN (3, 4, 5) THEN '1' WHEN n % 10 = 6 THEN '4' ELSE 'NA' END
    AS now_relapsing,
  CASE WHEN n % 10 IN (7, 9) THEN '2' ELSE 'NA' END AS now_secondary,
  CASE event_type WHEN 'error' THEN 'NA' ELSE CAST(1992 + n % 12 AS VARCHAR) END
    AS diagnosis_year,
  CASE event_type WHEN 'signup' THEN 'NA' WHEN 'view' THEN NULL
       ELSE CAST(n % 14 AS VARCHAR) END AS diagnosis_month,
  CASE n % 6 WHEN 4 THEN 'NA' WHEN 5 THEN '7' ELSE CAST(n % 6 AS VARCHAR) END
    AS type_at_diagnosis FROM event_n"""
VIEWS["clinic_row"] = f"""
SELECT c_custkey, CASE WHEN c_acctbal <= 9900 THEN c_custkey END AS person_id,
  {BIRTH} AS birth_date, {area('c_nationkey')} AS area_code,
  CAST(1 + c_custkey % 2 AS INTEGER) AS gender_cd, c_acctbal,
  CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'MS' ELSE 'OTHER' END
    AS diagnosis,
  CASE WHEN c_acctbal >= 7900 AND c_acctbal < 8000 THEN NULL
       ELSE DATE '1994-06-01' + CAST(c_custkey * 13 % 2400 AS INTEGER) END AS diagnosis_date
FROM customer WHERE c_acctbal >= 2000"""
VIEWS["clinic_listed"] = """
SELECT c.person_id, c.birth_date, c.area_code, r.district_code, c.gender_cd, c.diagnosis,
  c.diagnosis_date, c.onset_date
FROM (SELECT *, diagnosis_date - CAST(c_custkey % 1000 AS INTEGER) AS onset_date
      FROM clinic_row
      UNION ALL
      SELECT c_custkey, person_id, birth_date, area_code, gender_cd, c_acctbal, 'MS',
        diagnosis_date - 30, diagnosis_date - CAST(c_custkey % 1000 AS INTEGER)
      FROM clinic_row WHERE c_acctbal >= 8000 AND c_acctbal < 8500) c
LEFT JOIN region_area r ON c.area_code = r.area_code"""
VIEWS["codeset"] = f"""
SELECT * FROM (VALUES {codeset_rows()})
  AS v(concept, system, field, is_prefix, value, by_code)"""

# identity

VIEWS["trusted_person"] = f"""
SELECT DISTINCT person_id, birth_date, gender_cd FROM person_source
WHERE person_id IS NOT NULL AND link_status IN {TRUSTED}"""
VIEWS["one_birth"] = """
SELECT * FROM trusted_person WHERE person_id NOT IN (
  SELECT person_id FROM (SELECT DISTINCT person_id, birth_date FROM trusted_person)
  GROUP BY person_id HAVING count(*) > 1)"""
VIEWS["persons"] = """
SELECT DISTINCT person_id, birth_date, CASE WHEN person_id IN (
  SELECT person_id FROM (SELECT DISTINCT person_id, gender_cd FROM one_birth)
  GROUP BY person_id HAVING count(*) > 1) THEN 3 ELSE gender_cd END AS gender_cd
FROM one_birth"""
VIEWS["register_all"] = f"""
SELECT DISTINCT person_id, birth_date, gender_cd, starts_with(area_code, 'A') AS in_region
FROM register_link WHERE link_status IN {TRUSTED}"""
VIEWS["register_members"] = """
SELECT person_id FROM (SELECT DISTINCT person_id, birth_date, gender_cd FROM register_all)
GROUP BY person_id HAVING count(*) = 1"""
VIEWS["register_demo"] = f"""
SELECT CASE WHEN link_status IN {TRUSTED} THEN person_id END AS person_id, user_id, birth_date,
  gender_cd, area_code FROM register_link"""
VIEWS["reconciled"] = """
SELECT d.person_id, d.user_id, d.birth_date AS register_birth_date, d.gender_cd, d.area_code,
  p.birth_date AS record_birth_date,
  CASE WHEN p.birth_date IS NOT NULL AND p.birth_date <> d.birth_date THEN p.birth_date
       ELSE d.birth_date END AS birth_date
FROM register_demo d LEFT JOIN classified p ON d.person_id = p.person_id"""

# events

VIEWS["gp_tagged"] = f"""
SELECT DISTINCT e.person_id, e.event_date, 'GP' AS source, c.concept,
  CASE WHEN c.by_code THEN e.code END AS code
FROM gp_event e JOIN codeset c ON {code_match('e', 'GP')}
WHERE e.person_id IS NOT NULL AND e.event_date BETWEEN {FROM} AND {TO}"""
VIEWS["inpatient_tagged"] = f"""
SELECT DISTINCT s.person_id, s.admission_date AS event_date, 'HOSPITAL' AS source, c.concept,
  CASE WHEN c.by_code THEN d.code END AS code
FROM spell s JOIN episode e ON s.unit = e.unit AND s.spell_no = e.spell_no
JOIN inpatient_diag d ON e.unit = d.unit AND e.spell_no = d.spell_no
  AND e.episode_no = d.episode_no
JOIN codeset c ON {code_match('d', 'INPATIENT')}
WHERE s.person_id IS NOT NULL AND s.admission_date BETWEEN {FROM} AND {TO}"""
VIEWS["outpatient_tagged"] = f"""
SELECT DISTINCT v.person_id, d.attended_date AS event_date, 'HOSPITAL' AS source, c.concept,
  CASE WHEN c.by_code THEN d.code END AS code
FROM visit_diag d JOIN visit v ON d.unit = v.unit AND d.available_date = v.available_date
  AND d.attendance_id = v.attendance_id AND d.case_no = v.case_no
  AND d.attended_date = v.attended_date
JOIN codeset c ON {code_match('d', 'OUTPATIENT')}
WHERE v.person_id IS NOT NULL AND d.attended_date BETWEEN {FROM} AND {TO}"""
VIEWS["tagged"] = """
SELECT * FROM gp_tagged UNION SELECT * FROM inpatient_tagged
UNION SELECT * FROM outpatient_tagged"""

# deaths

VIEWS["gp_death"] = f"""
SELECT person_id, event_date AS death_date FROM gp_event
WHERE code IN (SELECT code FROM dictionary WHERE regexp_matches(code, '{DEATH_REGEX}'))
  AND person_id IS NOT NULL AND event_date >= birth_date AND event_year <= {CFG.year_max}"""
VIEWS["hospital_death"] = f"""
SELECT DISTINCT person_id, discharge_date AS death_date FROM spell
WHERE discharge_method = 4 AND discharge_date <= {TO}"""
VIEWS["deaths"] = """
SELECT person_id, death_date, 'REGISTER' AS death_source FROM death_register
UNION ALL
SELECT person_id, death_date, 'DEMOGRAPHICS' FROM demographics WHERE death_date IS NOT NULL
  AND person_id NOT IN (SELECT person_id FROM death_register)
UNION ALL
SELECT person_id, min(death_date), 'GP' FROM gp_death
WHERE person_id NOT IN (SELECT person_id FROM death_register)
  AND person_id NOT IN (SELECT person_id FROM demographics WHERE death_date IS NOT NULL)
GROUP BY person_id
UNION ALL
SELECT person_id, min(death_date), 'HOSPITAL' FROM hospital_death
WHERE person_id NOT IN (SELECT person_id FROM death_register)
  AND person_id NOT IN (SELECT person_id FROM demographics WHERE death_date IS NOT NULL)
  AND person_id NOT IN (SELECT person_id FROM gp_death)
GROUP BY person_id"""

# valid events and timelines

VIEWS["valid"] = f"""
SELECT t.person_id, t.event_date, t.source, t.concept, t.code, p.birth_date, p.gender_cd,
  {years('t.event_date', 'p.birth_date')} AS event_age, d.death_date
FROM tagged t JOIN persons p ON t.person_id = p.person_id
LEFT JOIN deaths d ON t.person_id = d.person_id
WHERE {years('t.event_date', 'p.birth_date')} >= 0
  AND (d.death_date IS NULL OR d.death_date >= t.event_date)"""
VIEWS["potential"] = "SELECT * FROM valid WHERE concept IN ('core', 'extra', 'nmo')"
VIEWS["contact"] = f"""
SELECT person_id, min(event_date) AS first_contact FROM gp_event
WHERE person_id IS NOT NULL AND link_status IN {TRUSTED} AND event_date >= birth_date
  AND event_year BETWEEN {CFG.year_min - 1} AND {CFG.year_max} GROUP BY person_id"""
VIEWS["core_ranked"] = """
SELECT person_id, event_date, row_number() OVER (PARTITION BY person_id
  ORDER BY event_date, source, death_date NULLS LAST) AS rn
FROM (SELECT DISTINCT person_id, event_date, source, death_date FROM valid
      WHERE concept = 'core')"""
VIEWS["event_counts"] = f"SELECT person_id, {ALL_COUNTS} FROM valid GROUP BY person_id"
VIEWS["first_core"] = """
SELECT person_id, min(event_date) AS core_date, min(event_age) AS core_age FROM valid
WHERE concept = 'core' GROUP BY person_id"""
VIEWS["first_potential"] = """
SELECT person_id, min(event_date) AS potential_date, min(event_age) AS potential_age
FROM potential GROUP BY person_id"""
VIEWS["nmo_span"] = """
SELECT person_id, min(event_date) AS nmo_date, min(event_age) AS nmo_age,
  max(event_date) AS nmo_last_date FROM valid WHERE concept = 'nmo' GROUP BY person_id"""
VIEWS["first_history"] = """
SELECT person_id, min(event_date) AS family_history_date, min(event_age) AS family_history_age
FROM valid WHERE concept = 'family_history' GROUP BY person_id"""
VIEWS["core_third"] = """
SELECT person_id, event_date AS core_event_3_date FROM core_ranked WHERE rn = 3"""
VIEWS["core_seventh"] = """
SELECT person_id, event_date AS core_event_7_date FROM core_ranked WHERE rn = 7"""

# residence

VIEWS["residents"] = f"""
SELECT DISTINCT person_id FROM home
WHERE (end_date = DATE '9999-01-01' OR end_date >= {TO}) AND start_date <= {TO}
  AND in_region = 1"""
VIEWS["located_home"] = f"SELECT * FROM home WHERE area_code IS NOT NULL AND start_date <= {TO}"
VIEWS["location"] = top(
    "located_home", "person_id", "end_date DESC NULLS FIRST, start_date DESC, area_code",
    "person_id, start_date AS location_start, end_date AS location_end, area_code")
VIEWS["household"] = top(
    "located_home", "person_id",
    "end_date DESC NULLS FIRST, start_date DESC, area_code, household_id",
    "person_id, start_date AS household_start, end_date AS household_end, "
    "area_code AS household_area_code, household_id")

# persons

VIEWS["known"] = """
SELECT p.*, c.first_contact, CASE p.gender_cd WHEN 1 THEN 'Male' WHEN 2 THEN 'Female'
  WHEN 3 THEN 'Undetermined' WHEN 9 THEN 'Undetermined' END AS gender
FROM persons p JOIN contact c ON p.person_id = c.person_id"""
VIEWS["frame"] = f"""
SELECT * FROM (
  SELECT k.*, CAST(year(k.birth_date) AS INTEGER) AS birth_year,
    f.core_date, f.core_age, o.potential_date, o.potential_age, n.nmo_date, n.nmo_age,
    n.nmo_last_date, t3.core_event_3_date, t7.core_event_7_date,
    h.family_history_date, h.family_history_age,
    CASE WHEN f.person_id IS NOT NULL THEN e.core_gp_count END AS core_gp_count,
    CASE WHEN f.person_id IS NOT NULL THEN e.core_hospital_count END AS core_hospital_count,
    d.death_date, d.death_source, CAST(year(d.death_date) AS INTEGER) AS death_year,
    CASE WHEN d.death_date <= {TO} THEN 1 ELSE 0 END AS dead,
    CASE WHEN d.death_date <= {TO} THEN d.death_date ELSE {TO} END AS exit_date,
    {years(f'(CASE WHEN d.death_date <= {TO} THEN d.death_date ELSE {TO} END)', 'k.birth_date')}
      AS age_current,
    l.area_code, l.location_start, l.location_end, ra.district_code, b.board,
    hh.household_id, hh.household_area_code, hra.district_code AS household_district_code,
    hh.household_start, hh.household_end, hb.board AS household_board
  FROM known k
  LEFT JOIN first_core f ON k.person_id = f.person_id
  LEFT JOIN event_counts e ON k.person_id = e.person_id
  LEFT JOIN first_potential o ON k.person_id = o.person_id
  LEFT JOIN nmo_span n ON k.person_id = n.person_id
  LEFT JOIN core_third t3 ON k.person_id = t3.person_id
  LEFT JOIN core_seventh t7 ON k.person_id = t7.person_id
  LEFT JOIN first_history h ON k.person_id = h.person_id
  LEFT JOIN deaths d ON k.person_id = d.person_id
  LEFT JOIN location l ON k.person_id = l.person_id
  LEFT JOIN region_area ra ON l.area_code = ra.area_code
  LEFT JOIN board_of b ON ra.district_code = b.district_code
  LEFT JOIN household hh ON k.person_id = hh.person_id
  LEFT JOIN region_area hra ON hh.household_area_code = hra.area_code
  LEFT JOIN board_of hb ON hra.district_code = hb.district_code)
WHERE age_current >= 0 AND birth_year < {CFG.birth_year_ceiling}"""
VIEWS["counts"] = f"""
SELECT k.person_id, coalesce(k.birth_date, NULL) AS birth_date,
  coalesce(k.gender_cd, 0) AS gender_cd, k.first_contact, coalesce(k.gender, '0') AS gender,
  {', '.join(f'coalesce(e.{c}, 0) AS {c}' for c in COUNT_NAMES)}
FROM known k LEFT JOIN event_counts e ON k.person_id = e.person_id"""
VIEWS["clean"] = f"""
SELECT * EXCLUDE (death_date, death_year),
  CASE WHEN death_date <= {TO} THEN death_date END AS death_date,
  CASE WHEN death_date <= {TO} THEN death_year END AS death_year,
  CAST(year(core_date) AS INTEGER) AS core_year,
  CAST(year(potential_date) AS INTEGER) AS potential_year,
  core_gp_count + core_hospital_count AS core_count,
  CASE WHEN death_date <= {TO} THEN {years('death_date', 'birth_date')} END AS age_death,
  CASE WHEN death_date <= {TO} THEN NULL ELSE {years(TO, 'birth_date')} END AS age_end
FROM frame
WHERE NOT (birth_year < {CFG.birth_year_floor} AND (death_date IS NULL OR death_date > {TO}))
  AND gender <> 'Undetermined'"""
VIEWS["classified"] = f"""
SELECT *, CASE WHEN core_date IS NOT NULL AND (potential_date - first_contact >=
  {CFG.min_gap_days} OR core_count >= {CFG.min_events}) THEN 1 ELSE 0 END AS is_case
FROM clean"""
VIEWS["alive"] = """
SELECT * FROM classified WHERE dead = 0 AND person_id IN (SELECT person_id FROM residents)"""
VIEWS["reasoned"] = f"""
SELECT *, CASE WHEN potential_date - first_contact >= {CFG.min_gap_days}
  THEN 'Over 6 Months From Earliest GP Entry' ELSE '3 or More Events' END AS reason
FROM classified WHERE is_case = 1"""
VIEWS["extra_people"] = """
SELECT * FROM classified WHERE core_date IS NULL AND potential_date IS NOT NULL"""

# questionnaire

VIEWS["onset_typed"] = f"""
SELECT *, {first_day('y', 'm')} AS onset_date FROM (
  SELECT user_id, completed, group_id, {number('onset_year')} AS y, {number('onset_month')} AS m
  FROM questionnaire)"""
VIEWS["diag_typed"] = f"""
SELECT *, {first_day('y', 'm', True)} AS diagnosis_date FROM (
  SELECT user_id, completed, group_id, {number('diagnosis_year')} AS y,
    {number('diagnosis_month')} AS m,
    CASE type_at_diagnosis WHEN '0' THEN 'PPMS' WHEN '1' THEN 'RRMS' WHEN '2' THEN 'SPMS'
      WHEN '3' THEN 'Unknown' END AS type_at_diagnosis FROM questionnaire)"""
VIEWS["now_typed"] = f"""
SELECT *, {first_day('y', 'm')} AS now_date, CASE answer WHEN '0' THEN 'PPMS'
  WHEN '1' THEN 'RRMS' WHEN '2' THEN 'SPMS' WHEN '4' THEN 'Benign' WHEN '3' THEN 'Unknown' END
  AS type_now FROM (
  SELECT user_id, completed, group_id, {number('now_year')} AS y, {number('now_month')} AS m,
    CASE WHEN now_unsure <> 'NA' THEN now_unsure WHEN now_primary <> 'NA' THEN now_primary
         WHEN now_relapsing <> 'NA' THEN now_relapsing
         WHEN now_secondary <> 'NA' THEN now_secondary END AS answer FROM questionnaire)"""


def latest(source: str, columns: str) -> str:
    joined = (f"(SELECT a.user_id, a.completed, a.group_id, {columns}, d.birth_date, d.gender_cd, "
              f"coalesce(d.person_id, -a.user_id) AS person_id FROM {source} a "
              f"LEFT JOIN reconciled d ON a.user_id = d.user_id)")
    return top(joined, "person_id",
               "completed DESC NULLS LAST, group_id DESC NULLS LAST, user_id, "
               "birth_date NULLS LAST, gender_cd NULLS LAST")


def age_at(column: str) -> str:
    return f"CASE WHEN {column} >= birth_date THEN {years(column, 'birth_date')} END"


VIEWS["answer_now"] = f"""
SELECT user_id, CAST(completed AS DATE) AS completed, group_id,
  CASE WHEN type_now IS NULL THEN 'Unknown' WHEN type_now IN ('Benign', 'RRMS')
       THEN 'Benign/RRMS' ELSE type_now END AS type_now, now_date, birth_date, gender_cd,
  person_id FROM ({latest('now_typed', 'a.type_now, a.now_date')})
WHERE now_date IS NULL OR now_date <= {TO}"""
VIEWS["answer_onset"] = f"""
SELECT *, CASE WHEN age_onset IS NULL THEN 'Missing' ELSE 'Present' END AS age_onset_known
FROM (SELECT user_id, CAST(completed AS DATE) AS completed, group_id, onset_date, birth_date,
        gender_cd, person_id, {age_at('onset_date')} AS age_onset
      FROM ({latest('onset_typed', 'a.onset_date')})
      WHERE onset_date IS NULL OR onset_date <= {TO})"""
VIEWS["answer_diag"] = f"""
SELECT *, CASE WHEN age_diagnosis IS NULL THEN 'Missing' ELSE 'Present' END
  AS age_diagnosis_known
FROM (SELECT user_id, CAST(completed AS DATE) AS completed, group_id,
        coalesce(type_at_diagnosis, 'Unknown') AS type_at_diagnosis, diagnosis_date, birth_date,
        gender_cd, person_id, {age_at('diagnosis_date')} AS age_diagnosis
      FROM ({latest('diag_typed', 'a.type_at_diagnosis, a.diagnosis_date')})
      WHERE diagnosis_date IS NULL OR diagnosis_date <= {TO})"""


def profile(population: str, members: str = "register_members", diagnosed: bool = True) -> str:
    within = f"AND d.diagnosis_date BETWEEN {DIAG_FROM} AND {DIAG_TO}" if diagnosed else ""
    return f"""
SELECT p.*, coalesce(n.type_now, 'Unknown') AS type_now, n.now_date, o.onset_date, o.age_onset,
  o.age_onset_known, coalesce(d.type_at_diagnosis, 'Unknown') AS type_at_diagnosis,
  d.diagnosis_date, d.age_diagnosis, d.age_diagnosis_known, d.completed AS submitted
FROM {population} p LEFT JOIN answer_now n ON p.person_id = n.person_id
LEFT JOIN answer_onset o ON p.person_id = o.person_id
LEFT JOIN answer_diag d ON p.person_id = d.person_id
WHERE p.person_id IN (SELECT person_id FROM {members}) {within}"""


VIEWS["profile_all"] = profile("classified")
VIEWS["register_in_region"] = """
SELECT person_id FROM (SELECT DISTINCT person_id, birth_date, gender_cd FROM register_all
  WHERE in_region) GROUP BY person_id HAVING count(*) = 1"""
VIEWS["register_narrow"] = f"""
SELECT person_id FROM (SELECT DISTINCT person_id, birth_date, gender_cd FROM register_link
  WHERE link_status IN {TRUSTED} AND area_code LIKE '{queries.NARROW.region_prefix}%') GROUP BY person_id HAVING count(*) = 1"""
VIEWS["profile_narrow"] = profile("classified", "register_narrow")
VIEWS["profile_in_region"] = profile("classified", "register_in_region")
VIEWS["profile_unfiltered"] = profile("classified", diagnosed=False)
VIEWS["profile_alive"] = profile("alive")
VIEWS["matched"] = """
SELECT p.*, p.potential_year AS diagnosis_year, p.potential_age AS diagnosis_age,
  CASE WHEN p.potential_age IS NULL THEN 'Missing' ELSE 'Present' END AS diagnosis_age_known,
  'Disease Present and Tested Positive' AS sub_group FROM profile_alive p
WHERE person_id IN (SELECT person_id FROM alive WHERE is_case = 1)
UNION ALL
SELECT p.*, NULL, NULL, 'Missing', 'Disease Present and Tested Negative' FROM profile_alive p
WHERE person_id NOT IN (SELECT person_id FROM alive WHERE is_case = 1)"""
VIEWS["single_users"] = """
SELECT person_id, any_value(birth_date) AS birth_date, any_value(gender) AS gender,
  any_value(onset_date) AS onset_date, any_value(age_onset) AS age_onset,
  any_value(age_onset_known) AS age_onset_known, any_value(type_now) AS type_now,
  any_value(type_at_diagnosis) AS type_at_diagnosis,
  any_value(diagnosis_date) AS diagnosis_date, any_value(age_diagnosis) AS age_diagnosis,
  any_value(invalid_user) AS invalid_user, 'Present' AS age_diagnosis_known
FROM (SELECT DISTINCT r.person_id, r.birth_date, r.gender, o.onset_date, o.age_onset,
        o.age_onset_known, n.type_now, d.type_at_diagnosis, d.diagnosis_date, d.age_diagnosis,
        CASE WHEN d.diagnosis_date IS NOT NULL AND r.birth_date IS NOT NULL
             AND r.birth_date <> DATE '1900-01-01' AND r.gender_cd IN (1, 2)
             THEN 0 ELSE 1 END AS invalid_user
      FROM (SELECT *  EXCLUDE (person_id), coalesce(person_id, -user_id) AS person_id,
              CASE gender_cd WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS gender
            FROM reconciled) r
      LEFT JOIN answer_now n ON r.person_id = n.person_id
      LEFT JOIN answer_onset o ON r.person_id = o.person_id
      LEFT JOIN answer_diag d ON r.person_id = d.person_id)
GROUP BY person_id HAVING count(*) = 1"""


def cases_by(rule) -> str:
    return f"""
SELECT person_id, potential_year, potential_age FROM alive WHERE core_date IS NOT NULL
  AND (potential_date - first_contact >= {rule.min_gap_days} OR core_count >= {rule.min_events})"""


def matched_by(cases: str) -> str:
    return f"""
SELECT p.*, c.potential_year AS diagnosis_year, c.potential_age AS diagnosis_age,
  CASE WHEN c.potential_age IS NULL THEN 'Missing' ELSE 'Present' END AS diagnosis_age_known,
  'Disease Present and Tested ' || CASE WHEN c.person_id IS NULL THEN 'Negative' ELSE 'Positive' END
    AS sub_group
FROM profile_alive p
LEFT JOIN (SELECT DISTINCT * FROM {cases}) c ON p.person_id = c.person_id"""


VIEWS["looser_cases"] = cases_by(queries.LOOSER)
VIEWS["looser_matched"] = matched_by("looser_cases")
VIEWS["stricter_cases"] = cases_by(queries.STRICTER)
VIEWS["stricter_matched"] = matched_by("stricter_cases")

# clinic list

VIEWS["clinic_first"] = top(
    "clinic_listed", "person_id",
    "diagnosis_date NULLS LAST, birth_date NULLS LAST, area_code NULLS LAST, "
    "district_code NULLS LAST, gender_cd NULLS LAST, diagnosis NULLS LAST, "
    "onset_date NULLS LAST",
    "person_id, birth_date, area_code, district_code, gender_cd, diagnosis, diagnosis_date, "
    "onset_date")
VIEWS["clinic_disease"] = f"""
SELECT *, {years('diagnosis_date', 'birth_date')} AS list_age_diagnosis,
  {years('onset_date', 'birth_date')} AS list_age_onset FROM clinic_first
WHERE diagnosis = 'MS' AND diagnosis_date BETWEEN {DIAG_FROM} AND {DIAG_TO}"""
VIEWS["clinic_pop"] = """
SELECT a.*, c.list_age_diagnosis, c.list_age_onset
FROM alive a JOIN clinic_disease c ON a.person_id = c.person_id"""
VIEWS["clinic_area"] = f"SELECT * FROM clinic_pop WHERE board = '{CFG.area_name}'"
VIEWS["area_pop"] = f"SELECT * FROM alive WHERE board = '{CFG.area_name}'"
VIEWS["alg_area"] = f"""
SELECT * FROM area_pop WHERE is_case = 1 AND potential_date <= {DIAG_TO}"""
VIEWS["alg_missing"] = """
SELECT * FROM alg_area WHERE person_id NOT IN (SELECT person_id FROM clinic_area)"""
VIEWS["no_hospital"] = "SELECT * FROM clinic_area WHERE core_hospital_count = 0"
VIEWS["other_listed"] = """
SELECT person_id FROM clinic_first WHERE person_id IN (SELECT person_id FROM alg_missing)"""
VIEWS["alg_unlisted"] = """
SELECT * FROM alg_missing WHERE person_id NOT IN
  (SELECT person_id FROM clinic_first WHERE person_id IS NOT NULL)"""
VIEWS["unlisted_gp"] = "SELECT * FROM alg_unlisted WHERE core_hospital_count = 0"
VIEWS["check_ids"] = """
SELECT person_id, 'Algorithm Only' AS "group" FROM alg_missing
UNION ALL SELECT person_id, 'Clinic List No Hospital Record' FROM no_hospital"""
VIEWS["checked"] = top(
    f"""(SELECT i.person_id, i."group", CASE WHEN s.unit IN ({SITES}) THEN 1 ELSE 0 END AS in_site
 FROM check_ids i JOIN spell s ON i.person_id = s.person_id)""",
    "person_id", '"group", in_site DESC', 'person_id, "group", in_site')
VIEWS["unit_of"] = """
SELECT 'U' || CAST(r_regionkey AS VARCHAR) AS unit, r_name AS unit_name FROM region"""
VIEWS["any_core_admission"] = f"""
SELECT DISTINCT s.person_id, s.unit, s.admission_date AS event_date
FROM spell s JOIN episode e ON s.unit = e.unit AND s.spell_no = e.spell_no
JOIN inpatient_diag d ON e.unit = d.unit AND e.spell_no = d.spell_no
  AND e.episode_no = d.episode_no
JOIN (SELECT * FROM codeset WHERE concept = 'core') c ON {code_match('d', 'INPATIENT')}
WHERE s.admission_date BETWEEN {FROM} AND {TO}"""
VIEWS["core_admission"] = """
SELECT * FROM any_core_admission WHERE person_id IN (SELECT person_id FROM alg_unlisted)"""
VIEWS["site_last"] = f"""
SELECT person_id, max(event_date) AS site_date FROM core_admission WHERE unit IN ({SITES})
GROUP BY person_id"""
VIEWS["elsewhere_last"] = f"""
SELECT person_id, max(event_date) AS elsewhere_date FROM core_admission
WHERE unit NOT IN ({SITES}) AND person_id NOT IN (SELECT person_id FROM site_last)
GROUP BY person_id"""
VIEWS["disagreement"] = """
SELECT c.person_id, c."group", c.in_site, s.site_date, x.elsewhere_date, a.gender,
  a.age_current, a.potential_age, a.core_gp_count, a.core_hospital_count
FROM checked c LEFT JOIN site_last s ON c.person_id = s.person_id
LEFT JOIN elsewhere_last x ON c.person_id = x.person_id
JOIN alive a ON c.person_id = a.person_id
WHERE c."group" = 'Algorithm Only'
  AND (s.site_date IS NOT NULL OR x.elsewhere_date IS NOT NULL)"""
VIEWS["left_1"] = """
SELECT * FROM alg_area WHERE person_id NOT IN (SELECT person_id FROM other_listed)"""
VIEWS["left_2"] = """
SELECT * FROM left_1 WHERE person_id NOT IN (SELECT person_id FROM unlisted_gp)"""
VIEWS["left_3"] = """
SELECT * FROM left_2 WHERE person_id NOT IN (SELECT person_id FROM elsewhere_last)"""
VIEWS["clinic_missed"] = """
SELECT * FROM clinic_area WHERE person_id NOT IN (SELECT person_id FROM alg_area)"""
VIEWS["negatives_1"] = """
SELECT person_id FROM area_pop WHERE person_id NOT IN (SELECT person_id FROM left_1)
  AND person_id NOT IN (SELECT person_id FROM clinic_missed)"""
VIEWS["negatives_2"] = """
SELECT person_id FROM area_pop WHERE person_id NOT IN (SELECT person_id FROM clinic_area)
  AND person_id NOT IN (SELECT person_id FROM alg_unlisted)"""


# description

def summary(source: str, columns: list[str]) -> str:
    parts = ["CAST(count(*) FILTER (WHERE gender = 'Female') AS BIGINT) AS female"]
    for c in columns:
        whole = f"count({c}) = count(*)"
        parts.append(f"CASE WHEN {whole} THEN round(avg({c}), 1) END AS mean_{c}")
        parts.append(f"CASE WHEN {whole} THEN round(stddev_samp({c}), 1) END AS sd_{c}")
    return f"SELECT {', '.join(parts)} FROM {source}"


def described(source: str, by: str, numeric: list[str], categorical: list[str],
              hide: str | None = None) -> str:
    parts = [
        f"SELECT {by} AS \"group\", '{c}' AS variable, CAST(NULL AS VARCHAR) AS level, "
        f"count({c}) AS n, CAST(NULL AS DOUBLE) AS pct, round(avg({c}), 4) AS mean, "
        f"round(stddev_samp({c}), 4) AS sd FROM {source} WHERE {c} IS NOT NULL GROUP BY 1"
        for c in numeric]
    hidden = f" WHERE level <> '{hide}'" if hide else ""
    parts += [
        f"SELECT * FROM (SELECT {by} AS \"group\", '{c}' AS variable, "
        f"CAST({c} AS VARCHAR) AS level, count(*) AS n, "
        f"round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY {by}), 4) AS pct, "
        f"CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd FROM {source} "
        f"WHERE {c} IS NOT NULL GROUP BY {by}, {c}){hidden}" for c in categorical]
    return " UNION ALL ".join(parts)


def chi_squared(source: str, by: str, c: str) -> str:
    return f"""
SELECT '{c}' AS variable, 'chi-squared' AS test,
  round(sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e), 4) AS statistic,
  (count(DISTINCT g) - 1) * (count(DISTINCT v) - 1) AS df1, CAST(NULL AS BIGINT) AS df2
FROM (SELECT r.g, k.v, t.o, r.n * k.n / CAST(a.n AS DOUBLE) AS e
  FROM (SELECT {by} AS g, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) r
  CROSS JOIN (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) k
  CROSS JOIN (SELECT count(*) AS n FROM {source} WHERE {c} IS NOT NULL) a
  LEFT JOIN (SELECT {by} AS g, {c} AS v, count(*) AS o FROM {source}
             WHERE {c} IS NOT NULL GROUP BY 1, 2) t ON t.g = r.g AND t.v = k.v)"""


def anova(source: str, by: str, c: str) -> str:
    return f"""
SELECT '{c}' AS variable, 'F' AS test,
  round((sum((gm - m) * (gm - m)) / (count(DISTINCT g) - 1))
        / (sum((x - gm) * (x - gm)) / (count(*) - count(DISTINCT g))), 4) AS statistic,
  count(DISTINCT g) - 1 AS df1, count(*) - count(DISTINCT g) AS df2
FROM (SELECT {by} AS g, {c} AS x, avg({c}) OVER (PARTITION BY {by}) AS gm, avg({c}) OVER () AS m
      FROM {source} WHERE {c} IS NOT NULL) HAVING count(*) > 0"""


VIEWS["table_one_rows"] = """
SELECT 'All Population' AS "group", gender, dead, age_end, age_death,
  CAST(NULL AS DOUBLE) AS diagnosis_age, CAST(NULL AS BIGINT) AS core_gp_count,
  CAST(NULL AS BIGINT) AS core_hospital_count FROM classified
UNION ALL SELECT 'Extra Codes Only', gender, dead, age_end, age_death, potential_age, NULL, NULL
  FROM extra_people
UNION ALL SELECT 'Register In Population', gender, dead, age_end, age_death, age_diagnosis, NULL,
  NULL FROM profile_all
UNION ALL SELECT 'Cases', gender, dead, age_end, age_death, potential_age, core_gp_count,
  core_hospital_count FROM classified WHERE is_case = 1"""
VIEWS["table_one_labelled"] = """
SELECT * REPLACE (CASE dead WHEN 1 THEN 'Dead' ELSE 'Alive' END AS dead) FROM table_one_rows"""
VIEWS["register_stacked"] = """
SELECT *, 'Algorithm - ' || sub_group AS all_group FROM matched
UNION ALL
SELECT *, NULL, NULL, 'Missing', '', 'All Register Population' FROM profile_alive"""
VIEWS["register_grouped"] = """
SELECT *, CASE WHEN type_now IN ('PPMS', 'SPMS') THEN 'Progressive' ELSE type_now END
    AS type_now_group,
  CASE WHEN type_at_diagnosis IN ('PPMS', 'SPMS') THEN 'Progressive' ELSE type_at_diagnosis END
    AS type_at_diagnosis_group FROM register_stacked"""
VIEWS["stage_rows"] = f"""
SELECT '{STAGE_AGE_GROUPS[2]}' AS "group", age_current, potential_age, age_onset, age_diagnosis
  FROM matched WHERE sub_group = 'Disease Present and Tested Positive'
UNION ALL SELECT '{STAGE_AGE_GROUPS[3]}', age_current, potential_age, list_age_onset,
  list_age_diagnosis FROM clinic_pop WHERE is_case = 1
UNION ALL SELECT '{STAGE_AGE_GROUPS[1]}', age_current,
  CASE WHEN is_case = 0 THEN NULL ELSE potential_age END, list_age_onset, list_age_diagnosis
  FROM clinic_pop
UNION ALL SELECT '{STAGE_AGE_GROUPS[0]}', age_current,
  CASE WHEN is_case = 0 THEN NULL ELSE potential_age END, age_onset, age_diagnosis
  FROM matched"""
VIEWS["stage_ages"] = """
SELECT *, age_diagnosis - age_onset AS onset_to_diagnosis FROM stage_rows"""


def shown(c: str) -> str:
    return (f"SELECT \"group\", '{c}' AS variable, printf('%.1f (%s), %d', "
            f"round(avg({c}), 1), coalesce(printf('%.1f', round(stddev_samp({c}), 1)), 'NA'), "
            f"count({c})) AS shown "
            f"FROM stage_ages WHERE {c} IS NOT NULL GROUP BY 1")


def one_total(population: str, ids: str, grand: bool) -> str:
    member = f"person_id IN (SELECT person_id FROM {ids})"
    parts = [f"SELECT '{population}' AS population, '{c}' AS code_type, count(*) AS people "
             f"FROM counts WHERE {member} AND {c}_gp_count + {c}_hospital_count > 0"
             for c in CONCEPTS]
    if grand:
        anything = " + ".join(COUNT_NAMES)
        parts.append(f"SELECT '{population}', 'Grand Total (All MS)', count(*) FROM counts "
                     f"WHERE {member} AND {anything} > 0")
    return " UNION ALL ".join(parts)


VIEWS["extra_alive"] = "SELECT * FROM alive WHERE core_date IS NULL AND potential_date IS NOT NULL"

COHORT_COLUMNS = ("person_id, gender, birth_date, first_contact, core_date, potential_date, "
                  "core_count, potential_age AS diagnosis_age, age_current")
PROFILE_COLUMNS = ("person_id, gender, birth_date, age_current, potential_date, type_now, "
                   "now_date, onset_date, age_onset, age_onset_known, type_at_diagnosis, "
                   "diagnosis_date, age_diagnosis")
GP_LIST = ", ".join(f"'{c}'" for c in queries.gp_codes())
BRACKET = ("CASE WHEN potential_age IS NULL THEN 'Error' WHEN potential_age < 10 THEN 'Under 10' "
           + " ".join(f"WHEN potential_age < {b + 5} THEN '{b} - {b + 4}'"
                      for b in range(10, 85, 5)) + " ELSE 'Over 85' END")
SIZES = {
    "algorithm in area": "alg_area", "clinic list in population": "clinic_pop",
    "clinic list in area": "clinic_area",
    "matched": "(SELECT * FROM alg_area WHERE person_id IN (SELECT person_id FROM clinic_area))",
    "algorithm only": "alg_missing", "clinic list without hospital record": "no_hospital",
    "clinic list missed by algorithm": "clinic_missed", "otherwise listed": "other_listed",
    "not listed": "alg_unlisted", "not listed, primary care only": "unlisted_gp",
}
STEPS = [("algorithm cases in area", "alg_area"),
         ("not otherwise listed by the clinic", "left_1"),
         ("not primary care only", "left_2"), ("not last admitted elsewhere", "left_3"),
         ("and not on the clinic list",
          "(SELECT * FROM left_3 WHERE person_id NOT IN (SELECT person_id FROM clinic_pop))")]

RESULTS: dict[str, str] = {
    "scan_coded_events": f"SELECT {EVENT_COLUMNS} FROM gp_event WHERE code IN ({GP_LIST}) "
                         f"AND person_id IS NOT NULL AND event_date BETWEEN {FROM} AND {TO}",
    "snapshot_events": f"SELECT {EVENT_COLUMNS} FROM gp_event WHERE code IN ({GP_LIST}) "
                       f"AND person_id IS NOT NULL AND event_date BETWEEN {FROM} AND {TO} "
                       f"AND event_date <= DATE '1998-12-31'",
    "prefix_codes": f"SELECT {EVENT_COLUMNS} FROM gp_event "
                    f"WHERE (code LIKE '1P%' OR code LIKE '2F%') "
                    f"AND person_id IS NOT NULL AND event_date BETWEEN {FROM} AND {TO}",
    "event_count_guard": f"SELECT count(*) AS event_count, "
                         f"CASE WHEN count(*) <= 900000 THEN 1 ELSE 0 END AS within_budget "
                         f"FROM gp_event WHERE code IN ({GP_LIST}) AND person_id IS NOT NULL "
                         f"AND event_date BETWEEN {FROM} AND {TO}",
    "identity_resolve": "SELECT * FROM persons",
    "register_cohort": "SELECT person_id, birth_date, gender_cd FROM register_all "
                       "WHERE in_region AND person_id NOT IN (SELECT person_id FROM register_all "
                       "WHERE in_region GROUP BY person_id HAVING count(*) > 1)",
    "surrogate_ids": "SELECT coalesce(person_id, -user_id) AS person_id, user_id, birth_date, "
                     "gender_cd, area_code FROM register_demo",
    "reconcile_demographics": "SELECT * FROM reconciled",
    "concept_tagging": "SELECT * FROM tagged",
    "regex_codes": f"SELECT * FROM dictionary WHERE regexp_matches(code, '{DEATH_REGEX}')",
    "inpatient_events": "SELECT * FROM inpatient_tagged",
    "outpatient_events": "SELECT * FROM outpatient_tagged",
    "union_sources": "SELECT DISTINCT person_id, event_date, source FROM tagged "
                     "WHERE concept = 'core'",
    "semi_filter": "SELECT person_id, unit, spell_no, admission_date FROM spell "
                   "WHERE person_id IN (SELECT person_id FROM death_register "
                   "UNION SELECT person_id FROM demographics)",
    "anti_filter": "SELECT * FROM person_source p WHERE NOT EXISTS (SELECT 1 FROM gp_tagged t "
                   "WHERE t.concept = 'core' AND t.person_id IS NOT DISTINCT FROM p.person_id)",
    "valid_events": "SELECT *, count(*) AS copies FROM valid GROUP BY ALL",
    "source_event_counts": "SELECT person_id, concept, count(*) FILTER (WHERE source = 'GP') "
                           "AS gp_count, count(*) FILTER (WHERE source = 'HOSPITAL') "
                           "AS hospital_count FROM valid GROUP BY person_id, concept",
    "first_contact": "SELECT * FROM contact",
    "registration_span": "SELECT person_id, min(admission_date) AS first_date, "
                         "max(admission_date) AS last_date FROM spell GROUP BY person_id",
    "first_event": top("potential", "person_id", "event_date, event_age",
                       "person_id, event_date AS first_date, event_age AS first_age"),
    "nth_event": "SELECT person_id, event_date AS nth_date FROM (SELECT *, row_number() OVER "
                 "(PARTITION BY person_id ORDER BY event_date, source, death_date NULLS LAST) "
                 "AS rn FROM (SELECT DISTINCT person_id, event_date, source, death_date "
                 "FROM potential)) WHERE rn = 3",
    "last_event": top("potential", "person_id", "event_date DESC",
                      "person_id, event_date AS last_date"),
    "person_features": f"SELECT v.*, f.core_date, f.core_age, t3.core_event_3_date, "
                       f"t7.core_event_7_date, o.potential_date, o.potential_age, n.nmo_date, "
                       f"n.nmo_age, n.nmo_last_date, h.family_history_date, "
                       f"h.family_history_age FROM event_counts v "
                       f"LEFT JOIN first_core f ON v.person_id = f.person_id "
                       f"LEFT JOIN first_potential o ON v.person_id = o.person_id "
                       f"LEFT JOIN nmo_span n ON v.person_id = n.person_id "
                       f"LEFT JOIN core_third t3 ON v.person_id = t3.person_id "
                       f"LEFT JOIN core_seventh t7 ON v.person_id = t7.person_id "
                       f"LEFT JOIN first_history h ON v.person_id = h.person_id",
    "death_cascade": "SELECT * FROM deaths",
    "latest_location": "SELECT * FROM location",
    "area_lookup": "SELECT h.*, r.district_code, b.board FROM (SELECT DISTINCT person_id, "
                   "area_code FROM home) h LEFT JOIN region_area r ON h.area_code = r.area_code "
                   "LEFT JOIN board_of b ON r.district_code = b.district_code",
    "person_frame": "SELECT * FROM frame",
    "person_counts": "SELECT * FROM counts",
    "clean_population": "SELECT * FROM clean",
    "classify_cases": "SELECT gender, dead, is_case, count(*) AS people, "
                      "min(potential_date) AS first_onset, max(core_count) AS most_events "
                      "FROM classified GROUP BY gender, dead, is_case",
    "alive_resident": "SELECT person_id, gender, birth_date, age_current, board, is_case "
                      "FROM alive",
    "case_cohort": f"SELECT {COHORT_COLUMNS}, reason, CASE WHEN reason = '3 or More Events' THEN "
                   f"{years('core_event_3_date', 'potential_date')} END AS time_to_trigger, "
                   f"potential_year AS diagnosis_year, {BRACKET} AS diagnosis_bracket "
                   f"FROM reasoned",
    "age_brackets": f"SELECT {BRACKET} AS bracket, count(*) AS people FROM frame GROUP BY 1",
    "extra_only": f"SELECT {COHORT_COLUMNS} FROM extra_people",
    "code_totals": "SELECT * FROM (" + " UNION ALL ".join([
        one_total("Everyone", "classified", True), one_total("Alive", "alive", True),
        one_total("Extra Codes Only", "extra_people", False),
        one_total("Extra Codes Only (Alive)", "extra_alive", False)])
                   + ") WHERE people > 0 OR code_type = 'Grand Total (All MS)'",
    "partial_dates": "SELECT o.user_id, o.group_id, o.y AS onset_year, o.m AS onset_month, "
                     "o.onset_date, d.y AS diagnosis_year, d.m AS diagnosis_month, "
                     "d.diagnosis_date FROM onset_typed o JOIN diag_typed d "
                     "ON o.group_id = d.group_id",
    "questionnaire_decode": "SELECT n.user_id, n.group_id, n.type_now, n.y AS now_year, "
                            "n.m AS now_month, n.now_date, d.type_at_diagnosis "
                            "FROM now_typed n JOIN diag_typed d ON n.group_id = d.group_id",
    "latest_response": "SELECT * FROM answer_now",
    "latest_onset": "SELECT * FROM answer_onset",
    "latest_diagnosis": "SELECT * FROM answer_diag",
    "singleton_groups": "SELECT * FROM single_users",
    "usable_users": "SELECT * FROM single_users WHERE invalid_user = 0",
    "register_profile": f"SELECT {PROFILE_COLUMNS}, submitted FROM profile_all",
    "match_miss": f"SELECT {PROFILE_COLUMNS}, diagnosis_year, diagnosis_age, "
                  f"diagnosis_age_known, sub_group, 'Algorithm - ' || sub_group AS all_group "
                  f"FROM matched",
    "register_profile_in_region": f"SELECT {PROFILE_COLUMNS} FROM profile_in_region",
    "register_profile_unfiltered": f"SELECT {PROFILE_COLUMNS} FROM profile_unfiltered",
    "register_diagnosed": "SELECT person_id, diagnosis_date, age_diagnosis FROM answer_diag "
                          "WHERE person_id IN (SELECT person_id FROM register_in_region) "
                          f"AND diagnosis_date BETWEEN {DIAG_FROM} AND {DIAG_TO}",
    "register_type_tallies": " UNION ALL ".join(
        f"SELECT '{c}' AS question, {c} AS type, count(*) AS people FROM profile_all GROUP BY 2"
        for c in ("type_now", "type_at_diagnosis")),
    **{name: f"SELECT {PROFILE_COLUMNS}, diagnosis_year, diagnosis_age, diagnosis_age_known, "
             f"sub_group, '{rule} - ' || sub_group AS all_group FROM {rule.lower()}_matched {where}"
       for name, rule, where in (
           ("match_miss_cohort", "Looser", ""), ("match_miss_stricter", "Stricter", ""),
           ("match_miss_known_type", "Looser", "WHERE type_at_diagnosis <> 'Unknown'"))},
    "register_profile_narrow_region": f"SELECT {PROFILE_COLUMNS} FROM profile_narrow",
    "register_group_tests": " UNION ALL ".join(
        [anova("register_grouped", "all_group", c) for c in queries.ACCURACY_AGES]
        + [chi_squared("register_grouped", "all_group", c) for c in queries.ACCURACY_LEVELS]),
    "conform_events": """
SELECT CASE WHEN event_id % 7 > 1 THEN user_id END AS person_id,
  CASE WHEN event_id % 5 > 2 THEN CAST(ts AS DATE) END AS event_date,
  CASE WHEN event_id % 3 > 0 THEN CAST(year(ts) AS INTEGER) END AS event_year,
  event_type AS code, CASE WHEN event_id % 4 > 0 THEN value END AS value, event_id AS sequence
FROM events""",
    "accuracy_table": described(
        "register_grouped", "all_group",
        ["age_onset", "diagnosis_age", "age_diagnosis", "age_end", "age_death"],
        ["gender", "type_at_diagnosis_group", "type_now_group", "age_onset_known",
         "diagnosis_age_known", "age_diagnosis_known"], hide="Missing"),
    "clinic_first_diagnosis": "SELECT * FROM clinic_first",
    "area_compare": " UNION ALL ".join(
        f"SELECT '{n}' AS comparison, count(*) AS people FROM {v}" for n, v in SIZES.items()),
    "site_check": 'SELECT "group", in_site, count(*) AS people FROM checked '
                  'GROUP BY "group", in_site',
    "site_admissions": f'SELECT i.person_id, i."group", s.unit, u.unit_name, '
                       f"CASE WHEN s.unit IN ({SITES}) THEN 1 ELSE 0 END AS in_site "
                       f"FROM check_ids i JOIN (SELECT DISTINCT person_id, unit FROM spell) s "
                       f"ON i.person_id = s.person_id LEFT JOIN unit_of u ON s.unit = u.unit",
    "core_admissions": "SELECT a.*, u.unit_name FROM any_core_admission a "
                       "LEFT JOIN unit_of u ON a.unit = u.unit",
    "disagreement_breakdown": "SELECT * FROM disagreement",
    "cohort_summary": summary("unlisted_gp", ["age_current", "potential_age", "core_gp_count"]),
    "recent_site_summary": summary(
        f"(SELECT * FROM disagreement WHERE year(site_date) >= {CFG.recent_site_year})",
        ["age_current", "potential_age", "core_gp_count", "core_hospital_count"]),
    "attrition": " UNION ALL ".join(
        f"SELECT {i} AS step, '{n}' AS label, count(*) AS people FROM {v}"
        for i, (n, v) in enumerate(STEPS, 1)),
    "confusion_matrix": """
SELECT algorithm, clinic_area, count(*) AS people,
  CASE WHEN algorithm = clinic_area THEN 'true ' ELSE 'false ' END
    || CASE WHEN algorithm = 1 THEN 'positive' ELSE 'negative' END AS cell
FROM (SELECT CASE WHEN person_id IN (SELECT person_id FROM alg_area) THEN 1 ELSE 0 END
        AS algorithm,
        CASE WHEN person_id IN (SELECT person_id FROM clinic_area) THEN 1 ELSE 0 END
        AS clinic_area FROM area_pop) GROUP BY algorithm, clinic_area""",
    "frame_equal": """
SELECT (SELECT count(*) FROM negatives_1) AS left_rows,
  (SELECT count(*) FROM negatives_2) AS right_rows,
  (SELECT count(*) FROM ((SELECT * FROM negatives_1 EXCEPT SELECT * FROM negatives_2)
   UNION (SELECT * FROM negatives_2 EXCEPT SELECT * FROM negatives_1))) AS differing_rows""",
    "table_one": described(
        "table_one_labelled", '"group"',
        ["diagnosis_age", "age_death", "age_end", "core_gp_count", "core_hospital_count"],
        ["gender", "dead"]),
    "group_tests": " UNION ALL ".join(
        [anova("(SELECT * FROM classified WHERE board IS NOT NULL)", "board", c)
         for c in ("age_current", "potential_age", "core_count")]
        + [chi_squared("(SELECT * FROM classified WHERE board IS NOT NULL)", "board", c)
           for c in ("gender", "dead", "is_case")]),
    "matched_ages": "SELECT CAST(CASE \"group\" "
                    + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(STAGE_AGE_GROUPS, 1))
                    + " END AS INTEGER) AS group_order, * FROM ("
                    + " UNION ALL ".join(shown(c) for c in (
                        "age_current", "potential_age", "age_onset", "age_diagnosis",
                        "onset_to_diagnosis")) + ")",
}


def needed(text: str, found: list[str]) -> None:
    """Views a statement refers to, in order of definition depth."""
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            needed(VIEWS[name], found)
            if name not in found:
                found.append(name)


# the same results by another road: a lookup read from a file, stages read from the catalog
RESULTS["csv_area_lookup"] = RESULTS["area_lookup"]
RESULTS["staged_cases"] = RESULTS["case_cohort"]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, text in RESULTS.items():
        views: list[str] = []
        needed(text, views)
        prefix = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
        out[name] = f"WITH {prefix}\n{text}" if views else text
    return out
