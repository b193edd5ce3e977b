"""Numeric scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M1: great-circle distance; infinite if a coordinate isn't finite."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    distance = F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.when(finite(lat1) & finite(lon1) & finite(lat2) & finite(lon2), distance).otherwise(F.lit(float("inf")))


def population_ratio(a: Column, b: Column) -> Column:
    """M2: the lesser by the greater, which counts as one at least."""
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    return F.least(a, b) / F.greatest(a, b, F.lit(1))
