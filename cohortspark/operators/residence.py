"""Where people live: resident at a date, most recent location, area lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.config import StudyConfig
from cohortspark.functions.rows import top_row


def resident_at_end(residence: DataFrame, cfg: StudyConfig) -> DataFrame:
    """People with an address in the region that spans the end of the study."""
    end, last_day = F.col("end_date"), F.lit(cfg.date_max)
    return residence.where(
        F.col("person_id").isNotNull()
        & ((end == F.lit(cfg.open_end)) | (end >= last_day))
        & (F.col("start_date") <= last_day)
        & (F.col("in_region") == 1)
    ).select("person_id").distinct()


def region_areas(area_lookup: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Latest district of each small area of the region."""
    return area_lookup.where(
        (F.col("is_latest") == 1) & F.col("area_code").startswith(cfg.region_prefix)
    ).select("area_code", "district_code").distinct()


def with_board(located: DataFrame, area_lookup: DataFrame, board_lookup: DataFrame,
               cfg: StudyConfig) -> DataFrame:
    """Add district and health board to rows with an area; unknown areas stay."""
    boards = board_lookup.select(F.col("district_code").alias("_district"), "board")
    return (
        located.join(region_areas(area_lookup, cfg), "area_code", "left")
        .join(boards, F.col("district_code") == F.col("_district"), "left").drop("_district")
    )


def latest_location(residence: DataFrame, cfg: StudyConfig,
                    columns: Sequence[str] = ("area_code",)) -> DataFrame:
    """Each person's address with the latest end date among those begun by study end.

    A missing end sorts as the latest.  Equal ends go to the later start, then
    to the smallest remaining columns.
    """
    begun = residence.where(
        F.col("person_id").isNotNull() & F.col("area_code").isNotNull()
        & (F.col("start_date") <= F.lit(cfg.date_max))
    ).select("person_id", "start_date", "end_date", *columns)
    return top_row(begun, ["person_id"],
                   [F.col("end_date").desc_nulls_first(), F.col("start_date").desc()]) \
        .withColumnsRenamed({"start_date": "location_start", "end_date": "location_end"})
