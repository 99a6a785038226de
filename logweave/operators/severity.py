"""Severity order, weights and decay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities in rising order and their weights in a risk score.
ORDER = ("informational", "low", "medium", "high", "critical")
WEIGHTS = {"critical": 10.0, "high": 6.0, "medium": 3.0, "low": 1.0, "informational": 0.5}
OTHER_WEIGHT = 1.0


def rank(level: Column) -> Column:
    """0 to 4; an unknown severity ranks as medium."""
    found = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.lower(F.btrim(F.coalesce(level, F.lit("")))))
    return F.when(found > 0, found - 1).otherwise(ORDER.index("medium")).cast("int")


def name(rank_: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in ORDER]), rank_)


def highest(level: Column) -> Column:
    """Aggregate: the highest severity of a group, medium if there is none."""
    return F.coalesce(F.max_by(F.lower(level), F.when(level.isNotNull(), rank(level))), F.lit("medium"))


def weight(level: Column) -> Column:
    low = F.lower(F.btrim(level))
    return reduce(lambda acc, x: acc.when(low == x[0], x[1]), list(WEIGHTS.items())[1:], F.when(low == "critical", WEIGHTS["critical"])).otherwise(OTHER_WEIGHT)


def decay(age_seconds: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0.0)) / F.lit(max(half_life_days, 1e-3) * 86400.0))
