"""Study parameters shared by all operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

# Study period, link statuses counted as trusted, open-end sentinel.
DEFAULT_YEAR_MIN = 1970
DEFAULT_YEAR_MAX = 2020
TRUSTED_LINKS = (1, 4, 39)
OPEN_END = date(9999, 1, 1)


@dataclass(frozen=True)
class StudyConfig:
    """Everything that varies between two studies run with the same operators."""

    year_min: int = DEFAULT_YEAR_MIN
    year_max: int = DEFAULT_YEAR_MAX
    trusted_links: tuple[int, ...] = TRUSTED_LINKS
    open_end: date = OPEN_END
    # case rule
    min_gap_days: int = 180
    min_events: int = 3
    # population rules
    birth_year_floor: int = 1910
    birth_year_ceiling: int = 2020
    undetermined_gender: int = 3
    # area rules
    region_prefix: str = "W"
    # the clinic's area and sites; nobody is in an area, nor a unit a site, until they are named
    area_name: str = ""
    site_units: tuple[str, ...] = ()
    recent_site_year: int = 2015
    # death rows are kept as recorded unless this is set
    dedupe_deaths: bool = False
    household_location: bool = True
    # table naming
    namespace: str = ""
    snapshots: Mapping[str, str] = field(default_factory=dict)
    # read each dataset from its latest snapshot not after this day (YYYYMMDD), unless named above
    as_of: str = ""
    # lookups kept as CSV files: dataset and path
    lookup_files: Mapping[str, str] = field(default_factory=dict)

    @property
    def date_min(self) -> date:
        return date(self.year_min, 1, 1)

    @property
    def date_max(self) -> date:
        return date(self.year_max, 12, 31)

    @property
    def diagnosis_min(self) -> date:
        return self.date_min

    @property
    def diagnosis_max(self) -> date:
        """Reference diagnoses count up to the first day of the last study year."""
        return date(self.year_max, 1, 1)

    def table(self, name: str, snapshot: str | None = None) -> str:
        """Name of a dataset's table or path for the chosen snapshot date."""
        stamp = snapshot or self.snapshots.get(name)
        resolved = f"{name}_{stamp}" if stamp else name
        return f"{self.namespace}{resolved}"
