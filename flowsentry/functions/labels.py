"""Mappings from predicted labels, severities and alert types to the classes reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry import schemas as S


def _col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def threat_level(label: Column | str) -> Column:
    """Label → safe / suspicious / danger. A missing label is safe, an unlisted one is danger."""
    name = F.upper(_col(label))
    return (F.when(name.isNull() | name.isin(S.SAFE_LABELS), "safe")
            .when(name == "SUSPICIOUS", "suspicious").otherwise("danger"))


def counts_as_attack(label: Column | str) -> Column:
    """The statistics test: exact spellings, and unlike `threat_level` it lets Unknown pass as safe."""
    return ~F.coalesce(_col(label), F.lit("Normal")).isin(S.STATS_SAFE_LABELS)


def ensemble_level(label: Column | str) -> Column:
    return F.when(F.lower(_col(label)) == "normal", "SAFE").otherwise("DANGER")


def attack_bucket(alert_type: Column | str) -> Column:
    """Named attack or Other; null for types that are not attacks."""
    kind = F.coalesce(_col(alert_type), F.lit("Normal"))
    return F.when(kind.isin(S.NAMED_ATTACKS), kind).when(~kind.isin(S.IGNORED_ALERT_TYPES), "Other")


def chart_class(level: Column | str) -> Column:
    """Series a record is drawn in: threats, suspicious or normal."""
    name = F.lower(_col(level))
    return (F.when(name.isin(S.CHART_THREATS), "threats")
            .when(name.isin(S.CHART_SUSPICIOUS), "suspicious").otherwise("normal"))


def severity_rank(severity: Column | str) -> Column:
    """0 for safe up to 3 for danger; unknown severities rank lowest."""
    name = F.lower(_col(severity))
    rank = F.when(name == S.SEVERITIES[-1], len(S.SEVERITIES) - 1)
    for i in range(len(S.SEVERITIES) - 2, 0, -1):
        rank = rank.when(name == S.SEVERITIES[i], i)
    return rank.otherwise(0)


def severity_name(rank: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in S.SEVERITIES]), _col(rank) + 1)


def title_case(text: Column | str) -> Column:
    return F.initcap(F.replace(_col(text), F.lit("_"), F.lit(" ")))
