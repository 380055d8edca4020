"""Date and age expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def years_between(later: Column, earlier: Column) -> Column:
    """Elapsed years to two decimals; null when either date is null."""
    return F.round(F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR), 2)


def whole_number(text: Column) -> Column:
    """Integer for text made of digits only, otherwise null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def partial_date(year: Column, month: Column, year_max: int, *,
                 missing_month_is_january: bool = False) -> Column:
    """First day of the answered month; month 0 means that only the year is known.

    Null when the year is outside ``1..year_max`` or the month is not ``0..12``.
    """
    # make_date raises on bad input, so it only ever sees a month forced into range
    known = F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    usable = (year > 0) & (year <= year_max)
    result = F.when(usable & month.between(0, 12), known)
    if missing_month_is_january:
        result = result.when(usable & month.isNull(), F.make_date(year, F.lit(1), F.lit(1)))
    return result
