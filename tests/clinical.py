"""A small hand-made clinical data set, with the awkward cases spelled out."""

from datetime import date

from cohortspark.sources.tables import schema_of

D = date


def d(text):
    return date.fromisoformat(text) if text else None


def frames(spark, **rows):
    """Input tables from row tuples; tables that are not given are empty."""
    from cohortspark.sources.tables import SCHEMAS

    return {n: spark.createDataFrame(rows.get(n, []), schema_of(n)) for n in SCHEMAS}


def gp(person, day, code, birth="1960-01-01", status=1):
    when = d(day)
    return (person, when, when.year, code, None, None, None, None, d(birth), status)


def study_rows():
    """Persons 1..9 of a study over 1970-2020.

    1 long gap before onset; 2 three events in a short time; 3 two events in a short
    time; 4 extra code only; 5 dead by register; 6 two birth dates; 7 two genders;
    8 no event codes; 9 born before 1910 without death.
    """
    persons = [(1, d("1960-01-01"), 2, 1), (2, d("1970-05-05"), 1, 4), (3, d("1980-03-03"), 2, 39),
               (4, d("1990-01-01"), 1, 1), (5, d("1950-01-01"), 2, 1),
               (6, None, 1, 1), (6, d("1980-01-01"), 1, 1),
               (7, d("1985-01-01"), 1, 1), (7, d("1985-01-01"), 2, 1),
               (8, d("1975-01-01"), 1, 1), (8, d("1975-01-02"), 1, 99),
               (9, d("1905-01-01"), 2, 1), (None, d("1960-01-01"), 1, 1)]
    contacts = [gp(p, "2000-01-01", "xxxxx", b) for p, b in (
        (1, "1960-01-01"), (2, "1970-05-05"), (3, "1980-03-03"), (4, "1990-01-01"),
        (5, "1950-01-01"), (6, "1980-01-01"), (7, "1985-01-01"), (8, "1975-01-01"),
        (9, "1905-01-01"))]
    coded = [gp(1, "2001-06-01", "F20.."), gp(2, "2000-02-01", "F20.."),
             gp(2, "2000-02-01", "F20.."), gp(2, "2000-03-01", "F20.."),
             gp(3, "2000-02-01", "F20.."), gp(3, "2000-03-01", "F20.."),
             gp(4, "2005-01-01", "F4H3."), gp(5, "2003-01-01", "F20.."),
             gp(5, "2011-01-01", "F20.."), gp(6, "2003-01-01", "F20.."),
             gp(7, "2003-01-01", "F20.."), gp(1, "2002-01-01", "1292.")]
    spells = [("A1", 10, 2, d("2000-04-01"), d("2000-04-03"), 1),
              ("RYC", 11, 1, d("2010-04-01"), d("2010-04-03"), 1)]
    episodes = [("A1", 10, 1), ("A1", 10, 1), ("RYC", 11, 1)]
    diagnoses = [("A1", 10, 1, "G35", "G35X"), ("A1", 10, 2, "G35", "G35X"),
                 ("RYC", 11, 1, "G36", "G360"), ("RYC", 11, 9, "G35", "G35X")]
    visits = [("A1", d("2006-01-02"), 1, 1, d("2006-01-01"), 4),
              ("A1", d("2006-01-02"), 2, 1, d("2006-02-01"), 4)]
    visit_codes = [("A1", d("2006-01-02"), 1, 1, d("2006-01-01"), "H46", None),
                   ("A1", d("2006-01-02"), 2, 1, d("2006-02-01"), "H46", "X")]
    return dict(
        person_source=persons, gp_event=contacts + coded, inpatient_spell=spells,
        inpatient_episode=episodes, inpatient_diagnosis=diagnoses, outpatient=visits,
        outpatient_diagnosis=visit_codes,
        death_register=[(5, d("2010-01-01")), (5, d("2010-01-01"))],
        residence=[(p, d("1990-01-01"), d("9999-01-01"), 1) for p in range(1, 10)],
        residence_area=[(p, d("1990-01-01"), d("9999-01-01"), "W01", 1) for p in range(1, 10)],
        area_lookup=[("W01", "D1", 1), ("W01", "D0", 0)],
        board_lookup=[("D1", "North")],
    )
