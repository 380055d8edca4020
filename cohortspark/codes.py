"""Code sets: which codes, in which kind of record, stand for which concept.

Rules are a short driver-side parameter, so they become literal predicates that
reach the Parquet scan (``In`` and ``StringStartsWith`` filters).  Code lists
that come from data (dictionaries) stay DataFrames and are semi-joined instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GP = "GP"
INPATIENT = "INPATIENT"
OUTPATIENT = "OUTPATIENT"

CORE = "core"
EXTRA = "extra"
NMO = "nmo"
FAMILY_HISTORY = "family_history"
# Concepts whose events are told apart by code as well as by day.
CODED_CONCEPTS = (
    "optic_neuritis",
    "transverse_myelitis",
    "encephalitis",
    "cns_demyelination",
    "acute_demyelination",
)
COUNTED_CONCEPTS = (CORE, *CODED_CONCEPTS, NMO)


@dataclass(frozen=True)
class CodeRule:
    """``field`` is ``code`` (whole code) or ``stem`` (its first three characters)."""

    concept: str
    system: str
    value: str
    field: str = "code"
    prefix: bool = False


@dataclass(frozen=True)
class CodeSet:
    rules: tuple[CodeRule, ...]
    by_code: tuple[str, ...] = CODED_CONCEPTS

    def concepts(self, system: str) -> list[str]:
        return list(dict.fromkeys(r.concept for r in self.rules if r.system == system))

    def only(self, *concepts: str) -> CodeSet:
        return CodeSet(tuple(r for r in self.rules if r.concept in concepts), self.by_code)

    def condition(self, system: str, concept: str | None = None) -> Column:
        """Predicate for one concept, or for any concept of the system."""
        rules = [r for r in self.rules
                 if r.system == system and concept in (None, r.concept)]
        if not rules:
            return F.lit(False)
        terms = [F.col(r.field).startswith(r.value) for r in rules if r.prefix]
        for name in ("code", "stem"):
            exact = list(dict.fromkeys(r.value for r in rules
                                       if r.field == name and not r.prefix))
            if exact:
                terms.append(F.col(name).isin(exact))
        return reduce(lambda a, b: a | b, terms)


def rules(concept: str, system: str, values: Iterable[str], **kw) -> tuple[CodeRule, ...]:
    return tuple(CodeRule(concept, system, v, **kw) for v in values)


def hospital(concept: str, values: Iterable[str], **kw) -> tuple[CodeRule, ...]:
    values = tuple(values)
    return (*rules(concept, INPATIENT, values, **kw), *rules(concept, OUTPATIENT, values, **kw))


def default_codeset() -> CodeSet:
    """The clinical code set of the study."""
    # Diagnosis codes per concept.
    return CodeSet((
        *rules(CORE, GP, ["F20.."]),
        *rules(CORE, INPATIENT, ["G35"], prefix=True),
        *rules(CORE, OUTPATIENT, ["G35"], field="stem"),
        *rules(EXTRA, GP, ["F4H3.", "F037.", "F21yz", "F21X.", "F21y."]),
        *hospital(EXTRA, ["H46"], field="stem"),
        *hospital(EXTRA, ["G373", "G369", "G378", "G368"]),
        *rules("optic_neuritis", GP, ["F4H3."]),
        *hospital("optic_neuritis", ["H46X"]),
        *rules("transverse_myelitis", GP, ["F037."]),
        *hospital("transverse_myelitis", ["G373"]),
        *rules("encephalitis", GP, ["F21X."]),
        *hospital("encephalitis", ["G369"]),
        *rules("cns_demyelination", GP, ["F21yz"]),
        *hospital("cns_demyelination", ["G378"]),
        *rules("acute_demyelination", GP, ["F21y."]),
        *hospital("acute_demyelination", ["G368"]),
        *rules(NMO, GP, ["F210."]),
        *hospital(NMO, ["G360"]),
        *rules(FAMILY_HISTORY, GP, ["1292."]),
    ))


# Patterns of GP codes that record a death, and the hospital discharge method.
DEATH_CODE_PATTERNS = (r"^94[1-9].{2}$", r"^94[A-G].{2}$", r"^22J.{2}$")
DEATH_DISCHARGE_METHOD = 4
