"""Distances, risk scores and tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(F.col(lon2) - F.col(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def device_risk(sims: Column, records: Column) -> Column:
    """0 for one SIM; else (sims - 1)^1.8 ln(1 + records)."""
    return F.when(sims > 1, F.round(F.pow(sims - 1.0, F.lit(1.8)) * F.log1p(records.cast("double")), 4)).otherwise(0.0)


def device_tier(sims: Column) -> Column:
    return F.when(sims >= 6, "critical").when(sims >= 4, "high").when(sims >= 3, "medium").otherwise("low")


def throughput(money_in: Column, money_out: Column) -> Column:
    return F.when(F.greatest(money_in, money_out) > 0, F.least(money_in, money_out) / F.greatest(money_in, money_out)).otherwise(0.0)


def mule_risk(in_degree: Column, out_degree: Column, ratio: Column, volume: Column) -> Column:
    return (in_degree + 1) * (out_degree + 1) * ratio * F.log1p(volume)


def fusion_risk(bank: Column, call: Column, session: Column, injected: Column) -> Column:
    """50 for three kinds, 30 for bank with one other, 0 otherwise; 100 more if injected."""
    base = F.when((bank > 0) & (call > 0) & (session > 0), 50).when((bank > 0) & ((call > 0) | (session > 0)), 30).otherwise(0)
    return base + F.when(injected, 100).otherwise(0)


def travel_severity(velocity: Column) -> Column:
    return F.when(velocity > 1200, "critical").otherwise("high")


def report_tier(score: Column) -> Column:
    return F.when(score >= 300, "CRITICAL").when(score >= 150, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")
