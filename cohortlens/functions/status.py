"""Tri-state observation status, groups, labels and aliases as Columns. Missing is NULL, never negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTED, NOT_DETECTED, UNAVAILABLE = "Detected", "Not detected", "Data unavailable"
# The words that the data model gives these meanings.
POSITIVE = ("detected", "positive", "present", "variant detected", "1", "true", "yes")
NEGATIVE = ("not detected", "not_detected", "negative", "reference", "wildtype", "wild type", "no variant", "no_variant", "absent", "0", "false", "no")
CASE_WORDS = ("case", "cancer", "tumor", "tumour")
CONTROL_WORDS = ("control", "healthy", "normal", "comparator")
LABEL_ONE = ("1", "true", "yes", "case", "cancer", "tumor", "tumour", "positive")
LABEL_ZERO = ("0", "false", "no", "control", "healthy", "normal", "negative")
EARLY, LATE = ("i", "ia", "ib", "ii", "iia", "iib", "early", "1", "2"), ("iii", "iiia", "iiib", "iiic", "iv", "iva", "ivb", "late", "3", "4")
FEATURE_TYPES = ("SNV", "INDEL", "CNV", "SV", "METHYLATION", "FRAGMENTOMICS", "MITOCHONDRIAL")
#: Types of measured values, with the columns that may hold them, first found first; the others are detected or not.
MEASURES = {"CNV": ("log2_ratio", "segment_mean"), "METHYLATION": ("beta", "m_value", "value"), "MITOCHONDRIAL": ("heteroplasmy", "copy_number_mt", "value")}
DENSE = ("SNV", "INDEL")
WORKFLOW = ("PASS", "FAIL", "WARN", "CONDITIONAL", "QUARANTINED")


def words(c: Column) -> Column:
    return F.lower(F.trim(c))


def observed(status: Column) -> Column:
    """1 detected, 0 not detected, NULL unobserved."""
    return F.when(words(status).isin(*POSITIVE), 1).when(words(status).isin(*NEGATIVE), 0)


def status_of(value: Column) -> Column:
    """The status column of 1, 0 or NULL, for sinks."""
    return F.when(value > 0, DETECTED).when(value == 0, NOT_DETECTED).otherwise(UNAVAILABLE)


def status_from_value(value: Column) -> Column:
    return F.when(value.isNull(), UNAVAILABLE).otherwise(DETECTED)


def canonical_status(status: Column) -> Column:
    """One of the three statuses whatever the case, else an error."""
    fixed = F.when(words(status) == "detected", DETECTED).when(words(status) == "not detected", NOT_DETECTED).when(words(status) == "data unavailable", UNAVAILABLE)
    return F.coalesce(fixed, F.raise_error(F.concat(F.lit("unknown feature status: "), F.coalesce(status, F.lit("NULL")))).cast("string"))


def canonical_workflow(status: Column) -> Column:
    return F.when(status.isin(*WORKFLOW), status).otherwise(F.raise_error(F.concat(F.lit("unknown workflow status: "), F.coalesce(status, F.lit("NULL")))).cast("string"))


def group_of(group: Column) -> Column:
    return F.when(words(group).isin(*CASE_WORDS), "case").when(words(group).isin(*CONTROL_WORDS), "control")


def cohort_label(group: Column) -> Column:
    return F.when(group_of(group) == "case", "Cancer").when(group_of(group) == "control", "Healthy").otherwise(UNAVAILABLE)


def feature_type(kind: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("SNV")))


def measure(kind: Column, present: list[str]) -> Column:
    """The finite number that a row of a measured type has; NULL for other types."""
    out = F.lit(None).cast("double")
    for k, names in MEASURES.items():
        out = F.when(kind == k, first_number(list(names), present)).otherwise(out)
    return out


def stage_group(stage: Column) -> Column:
    bare = F.regexp_replace(words(stage), r"^stage\s*", "")
    return F.when(bare.isin(*EARLY), "early").when(bare.isin(*LATE), "late")


def label(value: Column) -> Column:
    """1, 0 or NULL of a label in words or numbers."""
    number = value.cast("string").try_cast("double").try_cast("int")
    return F.when(words(value).isin(*LABEL_ONE), 1).when(words(value).isin(*LABEL_ZERO), 0).when(number.isin(0, 1), number)


def first_of(columns: list[str], present: list[str]) -> Column:
    """The first alias of a row that is neither null nor blank, of those that the table has."""
    own = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns if c in present]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def first_number(columns: list[str], present: list[str]) -> Column:
    """The first finite number among aliases."""
    own = [F.col(c).cast("string").try_cast("double") for c in columns if c in present]
    own = [F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) for x in own]
    return F.coalesce(*own) if own else F.lit(None).cast("double")


def truthy(value: Column, default: bool = True) -> Column:
    w = words(value.cast("string"))
    return F.when(w.isin("true", "1", "yes", "y", "pass", "ok"), True).when(w.isin("false", "0", "no", "n", "fail"), False).otherwise(F.lit(default))


def unit_score(value: Column) -> Column:
    """A number clamped to [0, 1]; NULL for what is no finite number."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
