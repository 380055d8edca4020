"""Who is who: trusted links, conflicting attributes, surrogate ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.config import TRUSTED_LINKS, StudyConfig
from cohortspark.functions.rows import many_values, single_row_ids, truthy


def trusted(status: str = "link_status", links: Iterable[int] = TRUSTED_LINKS) -> Column:
    return F.col(status).isin(list(links))


def resolve_identities(persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per trusted person: ``person_id, birth_date, gender_cd``.

    People with more than one birth date (a missing one counts) are dropped;
    people with more than one gender become undetermined.
    """
    grouped = (
        persons.where(F.col("person_id").isNotNull() & trusted(links=cfg.trusted_links))
        .groupBy("person_id")
        .agg(F.min("birth_date").alias("birth_date"),
             F.min("gender_cd").alias("gender_cd"),
             many_values("birth_date").alias("_births"),
             many_values("gender_cd").alias("_genders"))
    )
    return grouped.where(~F.col("_births")).select(
        "person_id", "birth_date",
        F.when(F.col("_genders"), F.lit(cfg.undetermined_gender))
        .otherwise(F.col("gender_cd")).cast("int").alias("gender_cd"),
    )


def register_cohort(links: DataFrame, cfg: StudyConfig, in_region: bool = True) -> DataFrame:
    """Trusted register members; ids with two different records are dropped."""
    keep = F.col("person_id").isNotNull() & trusted(links=cfg.trusted_links)
    if in_region:
        keep = keep & F.col("area_code").startswith(cfg.region_prefix)
    return single_row_ids(links.where(keep).select("person_id", "birth_date", "gender_cd"),
                          "person_id")


def register_demographics(links: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Every register record, with the person id blanked where the link is not trusted."""
    return links.select(
        F.when(trusted(links=cfg.trusted_links), F.col("person_id")).alias("person_id"),
        "user_id", "birth_date", "gender_cd", "area_code",
    )


def with_surrogate_ids(demographics: DataFrame) -> DataFrame:
    """Unlinked users get their negated user id, which never equals a person id."""
    return demographics.withColumn(
        "person_id", F.coalesce(F.col("person_id"), -F.col("user_id")))


def reconcile_birth_dates(demographics: DataFrame, population: DataFrame) -> DataFrame:
    """Register demographics with the population's birth date where the two disagree."""
    copies = [c for c in ("copies",) if c in population.columns]
    known = population.select("person_id", F.col("birth_date").alias("record_birth_date"), *copies)
    record, stated = F.col("record_birth_date"), F.col("register_birth_date")
    return (
        demographics.withColumnRenamed("birth_date", "register_birth_date")
        .join(known, "person_id", "left")
        .withColumn("birth_date", F.when(truthy(record != stated), record).otherwise(stated))
        .withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in copies})
    )
