"""Great-circle distance as a native Catalyst expression (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from courierflow.schema import EARTH_RADIUS_M


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def great_circle_m(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Haversine distance in metres between two (lat, lon) points in degrees."""
    phi1, phi2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = phi2 - phi1
    dlmb = F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlmb / 2), 2)
    h = F.least(F.lit(1.0), h)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(h))


def great_circle_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_RADIUS_M) -> str:
    """The same distance as an ANSI SQL expression (used by the oracles)."""
    return (
        f"({2.0 * radius!r} * asin(sqrt(least(1.0, "
        f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * "
        f"power(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"
    )
