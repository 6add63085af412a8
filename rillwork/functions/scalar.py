"""Scalar functions of the demos, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth's radius in km; the travel premium's bounds in km and rates per km; its daily cap.
EARTH_KM = 6371.0
FREE_KM, NEAR_KM, NEAR_RATE, FAR_RATE, DAILY_CAP = 5.0, 20.0, 0.45, 0.65, 50.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def travel_premium(km: Column) -> Column:
    """Nothing for near travel, then a rate per km, then a higher one."""
    near = (km - FREE_KM) * NEAR_RATE
    far = F.lit((NEAR_KM - FREE_KM) * NEAR_RATE) + (km - NEAR_KM) * FAR_RATE
    return F.when(km <= FREE_KM, 0.0).when(km <= NEAR_KM, near).otherwise(far)


def capped_sum(c: Column, cap: float = DAILY_CAP) -> Column:
    return F.least(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(cap))


def place_key(lat: Column, lng: Column) -> Column:
    """Coordinates rounded half to even at three places, as one text."""
    return F.concat_ws(",", F.bround(lat, 3).cast("string"), F.bround(lng, 3).cast("string"))


def ratio(part: Column, n: Column) -> Column:
    """A quotient that counts an empty divisor as one."""
    return part / F.greatest(n, F.lit(1))


def health(errors: Column, total: Column, n: Column) -> Column:
    """healthy below 5 % errors and a mean below 300, degraded below 15 %, else critical; without a division."""
    return (F.when((errors * 100 < n * 5) & (total < n * 300), "healthy")
            .when(errors * 100 < n * 15, "degraded").otherwise("critical"))
