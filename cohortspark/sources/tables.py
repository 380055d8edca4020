"""Reading inputs: declared schemas, snapshot-resolved names, pruned and filtered scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.config import StudyConfig
from cohortspark.sources.snapshots import latest_stamp

SCHEMAS: dict[str, str] = {
    "person_source": "person_id long, birth_date date, gender_cd int, link_status int",
    "gp_event": "person_id long, event_date date, event_year int, code string, "
                "code_version string, value double, episode string, sequence long, "
                "birth_date date, link_status int",
    "inpatient_spell": "unit string, spell_no long, person_id long, admission_date date, "
                       "discharge_date date, discharge_method int",
    "inpatient_episode": "unit string, spell_no long, episode_no int",
    "inpatient_diagnosis": "unit string, spell_no long, episode_no int, stem string, code string",
    "outpatient": "unit string, available_date date, attendance_id long, case_no long, "
                  "attended_date date, person_id long",
    "outpatient_diagnosis": "unit string, available_date date, attendance_id long, "
                            "case_no long, attended_date date, stem string, fourth string",
    "death_register": "person_id long, death_date date",
    "demographics": "person_id long, death_date date",
    "residence": "person_id long, start_date date, end_date date, in_region int",
    "residence_area": "person_id long, start_date date, end_date date, area_code string, "
                      "in_region int",
    "residence_household": "person_id long, start_date date, end_date date, area_code string, "
                           "in_region int, household_id long",
    "area_lookup": "area_code string, district_code string, is_latest int",
    "board_lookup": "district_code string, board string",
    "dictionary_a": "code string, description string",
    "dictionary_b": "code string, long_term string, short_term string",
    "register_link": "user_id long, person_id long, link_status int, birth_date date, "
                     "gender_cd int, area_code string",
    "questionnaire": "user_id long, completed timestamp, group_id long, onset_year string, "
                     "onset_month string, now_year string, now_month string, "
                     "now_unsure string, now_primary string, now_relapsing string, "
                     "now_secondary string, diagnosis_year string, diagnosis_month string, "
                     "type_at_diagnosis string",
    "clinic_link": "system_id long, person_id long, birth_date date, area_code string, "
                   "gender_cd int",
    "clinic_details": "system_id long, diagnosis string, diagnosis_date date, onset_date date",
    "provider_unit": "unit string, unit_name string",
}


# Lookups with one row per key.
LOOKUP_KEYS = {"board_lookup": "district_code", "provider_unit": "unit"}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a raw extract to its declared schema: cast types, drop code padding.

    Text that is no value of its column's type becomes null.

    Meant for ingest.  Doing it once, ahead of a stored table, keeps later
    filters on the bare columns so that they reach the Parquet scan.
    """
    columns = []
    for f in schema_of(name).fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            value = F.rtrim(value.cast("string"))
        if f.name in df.columns and isinstance(df.schema[f.name].dataType, T.StringType):
            value = value.try_cast(f.dataType)
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def open_table(spark: SparkSession, name: str, cfg: StudyConfig,
               snapshot: str | None = None) -> DataFrame:
    """The chosen snapshot of a dataset, from a path namespace or from the catalog.

    The snapshot is the one given, or the one the study names, or the latest
    by the study's ``as_of``.  Lookups kept as CSV files come from these.
    """
    if name in cfg.lookup_files:
        return read_lookup_csv(spark, cfg.lookup_files[name], SCHEMAS[name], LOOKUP_KEYS.get(name))
    if cfg.as_of and not (snapshot or name in cfg.snapshots):
        snapshot = latest_stamp(spark, cfg, name)
    resolved = cfg.table(name, snapshot)
    if "/" in resolved:
        return spark.read.schema(schema_of(name)).parquet(resolved)
    return spark.table(resolved)


def open_tables(spark: SparkSession, names: Sequence[str],
                cfg: StudyConfig) -> Mapping[str, DataFrame]:
    return {n: open_table(spark, n, cfg) for n in names}


class BadLookup(ValueError):
    """A lookup file has lines that do not fit its schema, or keys that are not unique."""


BAD_LINE = "_bad_line"
SHOWN_PROBLEMS = 20


def lookup_problems(raw: DataFrame, key: str | None = None) -> DataFrame:
    """``problem, detail`` of a lookup read with ``BAD_LINE``."""
    whole = F.to_csv(F.struct(*(c for c in raw.columns if c != BAD_LINE)))
    bad = F.when(F.col(BAD_LINE).isNotNull(), "bad line")
    if key is not None:
        bad = bad.when(F.col(key).isNull(), "no key")
    told = raw.select(bad.alias("problem"), F.coalesce(F.col(BAD_LINE), whole).alias("detail"),
                      *([F.col(key).cast("string").alias("_key")] if key else []))
    problems = told.where("problem IS NOT NULL").select("problem", "detail")
    if key is None:
        return problems
    repeated = told.where("problem IS NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return problems.unionByName(repeated.where("n > 1").select(
        F.lit("repeated key").alias("problem"), F.col("_key").alias("detail")))


def read_lookup_csv(spark: SparkSession, path: str, schema: str,
                    key: str | None = None) -> DataFrame:
    """A lookup kept as a CSV file whose header names the columns of the schema.

    Lines with too few or too many values or values of another type, and keys
    that are missing or not unique, which would multiply the rows of a join,
    are reported together; nothing is nulled or dropped in silence.
    """
    raw = spark.read.csv(path, header=True, schema=f"{schema}, {BAD_LINE} string",
                         mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE,
                         enforceSchema=False)
    found = lookup_problems(raw, key).limit(SHOWN_PROBLEMS).collect()
    if found:
        raise BadLookup(f"{path}: " + "; ".join(f"{r.problem}: {r.detail}" for r in found))
    return raw.drop(BAD_LINE)


def in_study(date_column: str, cfg: StudyConfig) -> Column:
    """Within the study period; a range on the date prunes row groups."""
    return F.col(date_column).between(F.lit(cfg.date_min), F.lit(cfg.date_max))


def scan_coded_events(events: DataFrame, cfg: StudyConfig, codes: Sequence[str] = (),
                      prefixes: Sequence[str] = (),
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Linked events of the study period with one of the codes or prefixes."""
    wanted = F.col("code").isin(list(codes)) if codes else F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("code").startswith(prefix)
    out = events.where(wanted & F.col("person_id").isNotNull() & in_study("event_date", cfg))
    return out.select(*columns) if columns else out
