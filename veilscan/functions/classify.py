"""Classification, access level and risk as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan import rules


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def data_classification(types: str | Column) -> Column:
    """CRITICAL if SSN/CREDIT_CARD, HIGH if DATE_OF_BIRTH/SALARY, MEDIUM if
    EMAIL/PHONE/NAME, LOW if ADDRESS/AGE, else NO_RISK (first tier wins)."""
    t = _col(types)
    expr = None
    for name, members in rules.RISK_TIERS:
        cond = F.arrays_overlap(t, _lit_array(members))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.coalesce(expr.otherwise(F.lit(rules.NO_RISK)), F.lit(rules.NO_RISK))


def access_level(classification: str | Column) -> Column:
    """Classification -> access level; unknown values (incl. the source
    profile's HIGH/MEDIUM) give INTERNAL."""
    c = _col(classification)
    expr = None
    for key, level in rules.ACCESS_LEVELS.items():
        expr = F.when(c == F.lit(key), F.lit(level)) if expr is None else expr.when(c == F.lit(key), F.lit(level))
    return expr.otherwise(F.lit(rules.DEFAULT_ACCESS_LEVEL))


def pii_classification(classification: str | Column) -> Column:
    c = _col(classification)
    return (
        F.when(c.isin(*rules.HIGHLY_SENSITIVE_CLASSES), F.lit("HIGHLY_SENSITIVE"))
        .when(c.isin(*rules.SENSITIVE_CLASSES), F.lit("SENSITIVE"))
        .otherwise(F.lit("CONFIDENTIAL"))
    )


def source_risk(types: str | Column) -> Column:
    """Source profile: NO_RISK without types, HIGH with more than two
    (duplicates count), else MEDIUM."""
    n = F.size(_col(types))
    return (
        F.when(n == 0, F.lit("NO_RISK"))
        .when(n >= rules.SOURCE_HIGH_RISK_MIN_TYPES, F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )


def source_governance(types: str | Column, risk: str | Column) -> Column:
    """PII_DETECTED for HIGH (or CRITICAL_RISK) sources, REQUIRES_MASKING for
    other sources with types, PUBLIC without types."""
    r = _col(risk)
    return (
        F.when(F.size(_col(types)) == 0, F.lit("PUBLIC"))
        .when(r.isin("HIGH", "CRITICAL_RISK"), F.lit("PII_DETECTED"))
        .otherwise(F.lit("REQUIRES_MASKING"))
    )


def primary_type(types: str | Column, none: str = "NONE") -> Column:
    return F.coalesce(F.try_element_at(_col(types), F.lit(1)), F.lit(none))


def types_string(types: str | Column) -> Column:
    """Comma-joined types (stable, hashable output form)."""
    return F.concat_ws(",", _col(types))
