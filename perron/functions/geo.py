"""Distances on the sphere as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_KM


def _chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """MTH-02: kilometres, arcsine form."""
    return F.asin(F.sqrt(_chord(lat1, lon1, lat2, lon2))) * (2 * EARTH_KM)


def haversine_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """MTH-03: kilometres, two-argument arctangent form."""
    c = _chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(c), F.sqrt(1 - c)) * (2 * EARTH_KM)
