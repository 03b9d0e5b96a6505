"""Great-circle, runway-frame and angle expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.config import (
    AIRPORT, DISTANCE_BINS, EARTH_RADIUS_M, LANDING_RUNWAYS, LEGACY_POINTS, METRES_PER_DEGREE, Runway,
)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def closest_runway_m(lat="lat", lon="lon") -> Column:
    """Distance to the nearest legacy runway point; the point list is fixed, so no join is needed."""
    return F.least(*[haversine_m(lat, lon, p[0], p[1]) for p in LEGACY_POINTS.values()])


def runway_struct(runway: Runway, order: int) -> Column:
    return F.struct(
        F.lit(order).alias("ord"), F.lit(runway.designator).alias("runway"),
        F.lit(runway.direction).alias("direction"), F.lit(runway.lat).alias("rwy_lat"),
        F.lit(runway.lon).alias("rwy_lon"), F.lit(runway.bearing).alias("bearing"),
        F.lit(runway.elevation).alias("elevation"),
    )


def landing_runways() -> Column:
    """The landing thresholds as an array literal: exploding it replaces a cross join."""
    return F.array(*[runway_struct(r, i) for i, r in enumerate(LANDING_RUNWAYS)])


def _offsets(lat, lon, rwy_lat, rwy_lon) -> tuple[Column, Column]:
    mean_lat = F.radians((lat + rwy_lat) / 2)
    east = F.radians(lon - rwy_lon) * EARTH_RADIUS_M * F.cos(mean_lat)
    north = F.radians(lat - rwy_lat) * EARTH_RADIUS_M
    return east, north


def along_track_m(lat="lat", lon="lon", rwy_lat="rwy_lat", rwy_lon="rwy_lon", bearing="bearing") -> Column:
    """Metres before the threshold on the landing course (negative once past it)."""
    east, north = _offsets(*map(_col, (lat, lon, rwy_lat, rwy_lon)))
    course = F.radians(_col(bearing))
    return -(east * F.sin(course) + north * F.cos(course))


def cross_track_m(lat="lat", lon="lon", rwy_lat="rwy_lat", rwy_lon="rwy_lon", bearing="bearing") -> Column:
    """Signed sideways displacement from the landing course."""
    east, north = _offsets(*map(_col, (lat, lon, rwy_lat, rwy_lon)))
    course = F.radians(_col(bearing))
    return east * F.cos(course) - north * F.sin(course)


def with_runway_frame(df, lat="lat", lon="lon"):
    """Add along, cross and dist for rows that carry rwy_lat, rwy_lon and bearing."""
    return df.withColumns({
        "along": along_track_m(lat, lon), "cross": cross_track_m(lat, lon),
        "dist": haversine_m(lat, lon, "rwy_lat", "rwy_lon"),
    })


def runway_to_lat(along, cross, rwy_lat="rwy_lat", bearing="bearing") -> Column:
    along, cross, rwy_lat, course = _col(along), _col(cross), _col(rwy_lat), F.radians(_col(bearing))
    north = -along * F.cos(course) - cross * F.sin(course)
    return rwy_lat + F.degrees(north / EARTH_RADIUS_M)


def runway_to_lon(along, cross, rwy_lat="rwy_lat", rwy_lon="rwy_lon", bearing="bearing") -> Column:
    lat = runway_to_lat(along, cross, rwy_lat, bearing)
    along, cross, course = _col(along), _col(cross), F.radians(_col(bearing))
    east = -along * F.sin(course) + cross * F.cos(course)
    return _col(rwy_lon) + F.degrees(east / (EARTH_RADIUS_M * F.cos(F.radians((lat + _col(rwy_lat)) / 2))))


def signed_angle(a, b) -> Column:
    """a − b folded into [−180, 180)."""
    return F.pmod(_col(a) - _col(b) + 180.0, F.lit(360.0)) - 180.0


def angle_between(a, b) -> Column:
    return F.abs(signed_angle(a, b))


def folded_change(current, previous) -> Column:
    """|current − previous|, folded at 180."""
    change = F.abs(_col(current) - _col(previous))
    return F.when(change > 180, 360 - change).otherwise(change)


def heading_from(sin_col, cos_col) -> Column:
    return F.pmod(F.degrees(F.atan2(_col(sin_col), _col(cos_col))), F.lit(360.0))


def east_of_airport_m(lat="lat", lon="lon") -> Column:
    return (_col(lon) - AIRPORT[1]) * METRES_PER_DEGREE * F.cos(F.radians(_col(lat)))


def north_of_airport_m(lat="lat") -> Column:
    return (_col(lat) - AIRPORT[0]) * METRES_PER_DEGREE


def distance_bin(along="along") -> Column:
    """Half-open distance label, null outside [0, 20000)."""
    along = _col(along)
    label = F.lit(None).cast("string")
    for low, high in zip(DISTANCE_BINS[:-1], DISTANCE_BINS[1:]):
        label = F.when((along >= low) & (along < high), F.lit(f"{int(low)}-{int(high)}")).otherwise(label)
    return label


def path_height_m(along, angle_deg: float) -> Column:
    return F.lit(math.tan(math.radians(angle_deg))) * F.greatest(_col(along), F.lit(0.0))
