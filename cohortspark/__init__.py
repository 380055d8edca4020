"""Case finding over linked event records, expressed as Spark DataFrame operators."""

from cohortspark.codes import CodeRule, CodeSet, default_codeset
from cohortspark.config import StudyConfig

__all__ = ["CodeRule", "CodeSet", "StudyConfig", "default_codeset"]
