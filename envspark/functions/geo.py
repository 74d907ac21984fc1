"""Great-circle geometry on latitude / longitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance on a sphere of radius 6371 km; NULL if any coordinate is NULL."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # rounding can push the chord a hair above 1 for antipodes; abs keeps the root real there
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.abs(1 - chord)))


def unit_vector(lat, lon) -> list[Column]:
    """x, y, z of the point on the unit sphere: distances compare like straight lines between such points."""
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
