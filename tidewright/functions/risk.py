"""Velocity, travel, merchants, behaviour and composite scores. All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Merchant categories by kind.
MERCHANTS = {
    "gambling": ("7995", "7800", "7801", "7802"),
    "cash_equivalent": ("6051", "6211", "6540"),
    "high_chargeback": ("5967", "5966"),
    "money_transfer": ("4829", "6012"),
}
KM_A_MILE = 1.609344
#: Travel speeds (km/h) from which a trip is suspicious, very suspicious, impossible.
SPEEDS = ((1000, "impossible"), (500, "highly_suspicious"), (200, "suspicious"))


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# -- velocity -------------------------------------------------------------------
def is_velocity_breach(count: Column, threshold: int) -> Column:
    return _known(count > threshold)


def velocity_score(count: Column, threshold: int) -> Column:
    """How far the count is above the threshold, as a share of it: 0 to 100."""
    return F.least(F.greatest((count - threshold) * 100.0 / threshold, F.lit(0.0)), F.lit(100.0))


def velocity_percentile(count: Column, mean: Column, deviation: Column) -> Column:
    """Percentile of the count in a normal distribution, by the logistic approximation."""
    z = F.try_divide(count - mean, deviation)
    return 100 / (1 + F.exp(-1.702 * z))


def burst_score(recent: Column, usual: Column) -> Column:
    """0 at the usual rate, 100 at five times of it and beyond."""
    return F.least(F.greatest((F.try_divide(recent, usual) - 1) * 25.0, F.lit(0.0)), F.lit(100.0))


# -- travel ---------------------------------------------------------------------
def miles(km: Column) -> Column:
    return km / KM_A_MILE


def speed_kmh(km: Column, hours: Column) -> Column:
    """Null without time between."""
    return F.try_divide(km, hours)


def is_impossible_travel(km: Column, hours: Column) -> Column:
    return _known(km > hours * SPEEDS[0][0])


def travel_verdict(km: Column, hours: Column) -> Column:
    out = F.lit("possible")
    for least, name in reversed(SPEEDS):
        out = F.when(km > hours * least, name).otherwise(out)
    return F.when(km.isNotNull() & hours.isNotNull(), out)


def listed(code: Column, codes: Sequence[str]) -> Column:
    """On a list of countries or merchants."""
    return _known(code.isin(*codes))


def score_of(code: Column, scores: dict[str, float], otherwise: float = 0.0) -> Column:
    table = F.create_map(*(F.lit(x) for pair in scores.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.lit(float(otherwise)))


# -- merchants ------------------------------------------------------------------
def merchant_kind(code: Column) -> Column:
    out = F.lit("other")
    for name, codes in reversed(MERCHANTS.items()):
        out = F.when(code.isin(*codes), name).otherwise(out)
    return F.when(code.isNotNull(), out)


def is_merchant(code: Column, kind: str) -> Column:
    return _known(code.isin(*MERCHANTS[kind]))


# -- behaviour ------------------------------------------------------------------
def is_odd_hours(t: Column, first: int, last: int, zone: str = "UTC") -> Column:
    """Hour of the zone's day in [first, last]; a span over midnight has first > last."""
    hour = F.hour(F.from_utc_timestamp(t, zone))
    return _known(hour.between(first, last) if first <= last else (hour >= first) | (hour <= last))


def is_weekend(t: Column, zone: str = "UTC") -> Column:
    return _known(F.weekday(F.from_utc_timestamp(t, zone)) >= 5)


def is_holiday(d: Column, days: Sequence[str]) -> Column:
    return _known(F.to_date(d).isin([F.to_date(F.lit(x)) for x in days]))


def dormancy_days(last: Column, on: Column) -> Column:
    return F.datediff(F.to_date(on), F.to_date(last))


def is_dormant(last: Column, days: int, on: Column) -> Column:
    return _known(dormancy_days(last, on) > days)


def deviation(value: Column, mean: Column, sd: Column) -> Column:
    return F.try_divide(value - mean, sd)


# -- scores ---------------------------------------------------------------------
def weighted_score(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean."""
    return sum((s * w for s, w in zip(scores, weights)), F.lit(0.0)) / sum(weights)


def normalize_score(raw: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((raw - low) * 100.0 / (high - low), F.lit(0.0)), F.lit(100.0))


def risk_level(score: Column, low_max: float = 30, medium_max: float = 60, high_max: float = 80) -> Column:
    return F.when(score <= low_max, "low").when(score <= medium_max, "medium").when(score <= high_max, "high").when(score.isNotNull(), "critical")


def combine(factors: dict[str, tuple[Column, float]]) -> Column:
    """Struct of the weighted score, its level and the factor that adds most."""
    score = weighted_score([c for c, _ in factors.values()], [w for _, w in factors.values()])
    parts = F.array(*(F.struct((c * w).alias("part"), F.lit(name).alias("name")) for name, (c, w) in factors.items()))
    return F.struct(score.alias("score"), risk_level(score).alias("level"), F.array_max(parts)["name"].alias("leading"))
