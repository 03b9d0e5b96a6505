"""Row derivations and filters of the historical feed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.config import AIRPORT, BBOX_HALF_WIDTH_DEG, MAX_RADIUS_M
from skyledger.functions.geo import closest_runway_m, heading_from
from skyledger.operators.sequence import grounded, throughout


def filter_bbox(df: DataFrame) -> DataFrame:
    """Cheap box before any trigonometry; it reaches the parquet scan as min/max filters."""
    return df.filter(F.col("lat").between(AIRPORT[0] - BBOX_HALF_WIDTH_DEG, AIRPORT[0] + BBOX_HALF_WIDTH_DEG)
                     & F.col("lon").between(AIRPORT[1] - BBOX_HALF_WIDTH_DEG, AIRPORT[1] + BBOX_HALF_WIDTH_DEG))


def filter_radius(df: DataFrame, radius_m: float = MAX_RADIUS_M) -> DataFrame:
    return df.filter(F.col("dist_to_runway_m") <= radius_m)


def filter_stale_contact(df: DataFrame, max_age_s: int = 15) -> DataFrame:
    return df.filter(F.col("time") - F.col("lastcontact") <= max_age_s)


def flight_phase() -> Column:
    low, rate, near = F.col("baroaltitude"), F.col("vertrate"), F.col("dist_to_runway_m")
    return (
        F.when(grounded() | (low < 50), "on_ground")
        .when((rate > 3) & (low < 3000), "takeoff").when(rate > 1, "climb")
        .when((rate <= -1) & (low < 3000) & (near < 20000), "approach").when(rate < -1, "descent").otherwise("cruise"))


def derive(df: DataFrame, operation: str = "unknown") -> DataFrame:
    """The derived columns of a state row."""
    with_distance = df.withColumns({
        "callsign": F.trim("callsign"), "time_utc": F.timestamp_seconds("time"), "velocity_kmh": F.col("velocity") * 3.6,
        "dist_to_runway_m": closest_runway_m()})
    rows = with_distance.withColumn("flight_phase", flight_phase())
    return rows if "operation" in df.columns else rows.withColumn("operation", F.lit(operation))


def filter_b(df: DataFrame, max_dist: float = 10_000.0, max_alt: float = 3_000.0) -> DataFrame:
    """Flights that come near and low; the per-flight minima are combined before the shuffle."""
    keep = df.groupBy("flight_id").agg(F.min("dist_to_runway_m").alias("d"), F.min("baroaltitude").alias("a")).filter(
        (F.col("d") < max_dist) & (F.col("a") < max_alt))
    return df.join(keep.select("flight_id"), "flight_id", "left_semi")


def engaging_parts() -> dict[str, Column]:
    near, no = F.col("dist_to_runway_m"), F.lit(False)
    return {
        "by_approach": F.coalesce((F.col("flight_phase") == "approach") & (near < 10_000), no),
        "by_onground": F.coalesce(grounded() & (near < 5_000), no),
        "by_takeoff": F.coalesce((F.col("flight_phase") == "takeoff") & (near < 5_000) & (F.col("baroaltitude") < 2_000), no),
    }


def engaging() -> Column:
    a, o, t = engaging_parts().values()
    return a | o | t


def filter_d(df: DataFrame) -> DataFrame:
    """Flights with an engaging row, then only their segments with one."""
    segment = throughout(["flight_id", "segment_id"])
    # A kept segment belongs to a kept flight, so the segment test alone gives both filters.
    return df.withColumn("engages", F.max(engaging()).over(segment)).filter("engages").drop("engages")


def heading_parts(heading: str = "heading") -> dict[str, Column]:
    return {"hdg_sin": F.sin(F.radians(heading)), "hdg_cos": F.cos(F.radians(heading))}


def replay_derived(df: DataFrame, into: str = "") -> DataFrame:
    """Recompute the derived channels from the measured ones, or those with a prefix from the measured ones that have it, else from the others."""
    lat, lon, heading = (into + c if into + c in df.columns else c for c in ("lat", "lon", "heading"))
    return df.withColumns({into + c: v for c, v in (heading_parts(heading) | {"dist_to_runway_m": closest_runway_m(lat, lon)}).items()})


def normalised_heading(df: DataFrame) -> DataFrame:
    """Unit sine and cosine (0, 1 where undefined) and the heading rebuilt from them."""
    norm = F.hypot("hdg_sin", "hdg_cos")
    unit = df.withColumn("norm_", norm).withColumns({
        "hdg_sin": F.when(F.col("norm_") > 0, F.col("hdg_sin") / F.col("norm_")).otherwise(0.0),
        "hdg_cos": F.when(F.col("norm_") > 0, F.col("hdg_cos") / F.col("norm_")).otherwise(1.0)})
    return unit.withColumn("heading", heading_from("hdg_sin", "hdg_cos")).drop("norm_")


def hour_cycle(time: str = "time") -> dict[str, Column]:
    hour = F.floor(F.pmod(F.col(time), F.lit(86_400)) / 3_600)
    return {"tod_sin": F.sin(hour * (2 * math.pi / 24)), "tod_cos": F.cos(hour * (2 * math.pi / 24))}
