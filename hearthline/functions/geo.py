"""Distances and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Earth radius and base grid step.
EARTH_RADIUS_KM = 6371.0
GRID_STEP = 0.01

KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bin_of(degrees: Column, step: float) -> Column:
    return F.floor(degrees / F.lit(float(step))).cast("bigint")


def grid_id(lat: Column, lon: Column, step: float = GRID_STEP) -> Column:
    return F.concat_ws("_", bin_of(lat, step).cast("string"), bin_of(lon, step).cast("string"))


def bin_center(bin_: Column, step: float) -> Column:
    return (bin_ + F.lit(0.5)) * F.lit(float(step))


def step_for_zoom(zoom: int | None) -> float:
    # Coarser cells at low zoom.
    if zoom is None or zoom > 8:
        return GRID_STEP
    return 0.04 if zoom <= 7 else 0.02


def plausible_gps(lat: Column, lon: Column) -> Column:
    ok = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def inside_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def lat_reach(radius_km: Column) -> Column:
    """Degrees of latitude within ``radius_km``, with a little slack."""
    return radius_km * (1.000001 / KM_PER_DEGREE)


def lon_reach(lat: Column, radius_km: Column) -> Column:
    """Degrees of longitude that can lie within ``radius_km`` of a point at ``lat``."""
    edge = F.least(F.lit(89.9), F.abs(lat) + lat_reach(radius_km))
    return F.least(F.lit(180.0), lat_reach(radius_km) / F.cos(F.radians(edge)))


def covering_bins(value: Column, reach: Column, step: Column) -> Column:
    """Bins of width ``step`` that meet ``value`` +- ``reach``."""
    low = F.floor((value - reach) / step).cast("bigint")
    high = F.floor((value + reach) / step).cast("bigint")
    return F.sequence(low, high)
