"""Code-to-label expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and answer codes that appear in results.
GENDERS = {1: "Male", 2: "Female", 3: "Undetermined", 9: "Undetermined"}
TYPE_NOW_ANSWERS = {"0": "PPMS", "1": "RRMS", "2": "SPMS", "4": "Benign", "3": "Unknown"}
TYPE_AT_DIAGNOSIS_ANSWERS = {"0": "PPMS", "1": "RRMS", "2": "SPMS", "3": "Unknown"}
NO_ANSWER = "NA"
UNKNOWN = "Unknown"
PRESENT, MISSING = "Present", "Missing"
BRACKET_START, BRACKET_WIDTH, BRACKET_END = 10, 5, 85


def decode(value: Column, labels: Mapping, default: str | None = None) -> Column:
    """Label of a code; ``default`` (null if not given) for codes without one."""
    result = F.lit(default).cast("string")
    for code, label in labels.items():
        result = F.when(value == F.lit(code), F.lit(label)).otherwise(result)
    return result


def first_answer(answers: Iterable[Column], no_answer: str = NO_ANSWER) -> Column:
    """The first answer that is neither null nor the no-answer mark."""
    return F.coalesce(*(F.nullif(a, F.lit(no_answer)) for a in answers))


def known_or_unknown(label: Column) -> Column:
    return F.coalesce(label, F.lit(UNKNOWN))


def merge_labels(label: Column, members: Iterable[str], merged: str) -> Column:
    return F.when(label.isin(list(members)), F.lit(merged)).otherwise(label)


def presence(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(PRESENT)).otherwise(F.lit(MISSING))


def age_bracket(age: Column) -> Column:
    """Five-year bracket with open ends; a null age is marked as an error."""
    lower = (F.floor(age / BRACKET_WIDTH) * BRACKET_WIDTH).cast("int")
    return (
        F.when(age.isNull(), "Error")
        .when(age < BRACKET_START, f"Under {BRACKET_START}")
        .when(age >= BRACKET_END, f"Over {BRACKET_END}")
        .otherwise(F.concat_ws(" - ", lower, lower + (BRACKET_WIDTH - 1)))
    )
