"""Distances, speeds and bounds on plain latitudes and longitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Prague region: least and greatest latitude and longitude, both inclusive. Fixed values.
PRAGUE = (49.9, 50.2, 14.2, 14.75)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance, in the atan2 form; null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    """Great-circle distance in metres, in the asin form with its argument held to 1."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.when(a.isNotNull(), F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def within(lat: Column, lon: Column, bounds: tuple[float, float, float, float] = PRAGUE) -> Column:
    return lat.between(bounds[0], bounds[1]) & lon.between(bounds[2], bounds[3])
